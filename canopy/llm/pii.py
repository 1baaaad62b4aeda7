"""Personal data by fixed patterns and a semi-Markov conditional random field.

Patterns give the base spans: e-mail addresses, IP addresses, payment cards and phone numbers. A semi-Markov CRF adds
what they miss (phone numbers without a plus, addresses written out with "at" and "dot"). It scores whole candidate
segments of up to LONGEST words with features of the entire span (shape of its digits, separators, check digit, what
surrounds it) and of the types of neighbouring segments; a dynamic program over segment ends, with entities of bounded
length and other words as segments of one, chooses boundaries and types together. Weights maximise the conditional
likelihood of segmentations, computed by the forward-backward recursion over segments.

Texts are cut into regions: runs of words with a digit, an "@" or a written-out address, and a word on either side.
Outside, every word is a segment of its own with score zero, so regions can be solved one by one.

The model is fitted on a bounded sample: of about MOST_TEXTS texts that look as if they held base spans, chosen by hash,
the regions with base spans and at most LONGEST_REGION words, REGIONS_A_TEXT of a text and MOST_REGIONS in all, with these
spans as the truth; and rewritten copies of them, two spans a region. All four are parameters. The corpus is read once
besides to count and draw the sample, by built-in functions, and once to be scanned. Decoded segments that meet a base
span are dropped; base spans always stay.

Null and empty texts have no spans. Positions are code points, ends exclusive. Rows are kept one for one, repeated ones
too. Without a single text to learn from, only base spans are returned. Extra columns don't matter.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopy.llm.common import slices

KINDS = ["email", "ip", "card", "phone"]
LONGEST, ROUNDS, PENALTY = 7, 20, 0.02
MOST_TEXTS, MOST_REGIONS, REGIONS_A_TEXT, LONGEST_REGION = 2000, 160, 4, 40

# The base patterns. The e-mail's local part is taken from the left of its "@". A match of four parts that
# starts within digits also starts before them, so that only starts of digits are tried.
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_WORD = re.compile(r"\S+")
_SIGN = re.compile(r"[0-9@]")
# Only starts of words are tried, and nothing is given back, so that the work is linear in texts without blanks as well.
_CUE = re.compile(r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+")
_SPOKEN = re.compile(r"(?i)(?<!\S)\S++\s++[(\[]?at[)\]]?\s++\S++(?:\s++[(\[]?dot[)\]]?\s++\S++)++")
_local = frozenset(_LOCAL)


def digits(text: str) -> list[int]:
    return [ord(c) - 48 for c in text if "0" <= c <= "9"]


def luhn(numbers: list[int]) -> bool:
    twice = [2 * d - 9 * (d > 4) for d in numbers[-2::-2]]
    return (sum(numbers[-1::-2]) + sum(twice)) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end), by kind as listed and then by start."""
    out, last = [], 0
    for m in _DOMAIN.finditer(text) if "@" in text else ():
        start = m.start()
        while start > last and text[start - 1] in _local:
            start -= 1
        if start < m.start():
            out.append((0, start, m.end()))
            last = m.end()
    out += [(1, *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        found = digits(m[0])
        if 13 <= len(found) <= 19 and luhn(found):
            out.append((2, *m.span()))
    out += [(3, *m.span()) for m in _PHONE.finditer(text) if 9 <= len(digits(m[0])) <= 15] if "+" in text else []
    return out


def regions(text: str) -> list[list[tuple[int, int]]]:
    """Runs of words (start, end) that may hold an entity, with a word of context on either side."""
    marks = [m.span() for m in _CUE.finditer(text)]
    lower = text.lower()
    if " dot " in lower or "[dot]" in lower or "(dot)" in lower:
        marks += [m.span() for m in _SPOKEN.finditer(text)]
    out: list[list[int]] = []
    for start, end in sorted(marks):
        if out and not text[out[-1][1] : start].strip():
            out[-1][1] = max(out[-1][1], end)
        elif out and start < out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    found = []
    for start, end in out:
        low = len(text[max(0, start - 80) : start].rstrip())
        before = text[max(0, start - 80) : start][:low]
        low = max(0, start - 80) + max(before.rfind(" "), before.rfind("\n")) + 1 if before else start
        after = re.compile(r"\s*\S*").match(text, end).end()
        found.append([m.span() for m in _WORD.finditer(text, low, after)])
    return found


def _trim(text: str, start: int, end: int) -> tuple[int, int]:
    """Without marks around that belong to the sentence or to markup."""
    while end > start and text[end - 1] in ".,;:!?\"'*%&$#|>]}":
        end -= 1
    while start < end and text[start] in "\"'<[{|*":
        start += 1
    if text[start:end].count(")") > text[start:end].count("("):
        end -= text[end - 1] == ")"
    return start, end


def span_features(text: str, words: list[tuple[int, int]], low: int, high: int) -> list[str]:
    """Features of the segment words[low:high] as a whole."""
    start, end = _trim(text, words[low][0], words[high - 1][1])
    span = text[start:end]
    found = digits(span)
    n = len(found)
    rest = re.sub(r"[0-9]", "", span)
    shape = re.sub(r"[A-Za-z]+", "a", re.sub(r"[0-9]+", "9", span))[:12]
    before = text[words[low - 1][0] : words[low - 1][1]].lower().strip(":.,") if low else ""
    out = [
        f"words={high - low}",
        f"digits={min(n, 20)}",
        f"shape={shape}",
        f"letters={any(c.isalpha() for c in span)}",
        f"first={span[:1] if not span[:1].isalnum() else '9' if span[:1].isdigit() else 'a'}",
        f"edges={words[low][0] == start},{words[high - 1][1] == end}",
        f"groups={min(6, len(re.findall('[0-9]+', span)))}",
    ]
    if n and set(rest) <= set(" -().+"):
        out.append("plain number")
        if 9 <= n <= 15 and high - low > 1 or 9 <= n <= 15 and "-" in rest:
            out.append("phone size, grouped")
        if 13 <= n <= 19:
            out.append(f"card size, luhn={luhn(found)}")
        if "(" in rest and ")" in rest:
            out.append("bracketed area")
        if re.search(r"555|[0-9]{3}[- .][0-9]{4}$", span):
            out.append("3-4 ending")
    if re.fullmatch(r"[0-9]{1,3}(\.[0-9]{1,3}){3}", span):
        out.append("four parts")
    if "@" in span:
        out.append(f"at sign, dots={'.' in span.rsplit('@', 1)[1]}")
    if re.fullmatch(r"(?is)[\w.+-]+\s+[(\[]?at[)\]]?\s+[\w-]+(\s+[(\[]?dot[)\]]?\s+[\w-]+)+", span):
        out.append("written-out address")
    if re.fullmatch(r"[0-9]{2,4}[-./][0-9]{1,2}[-./][0-9]{1,4}", span):
        out.append("date")
    if before in ("tel", "phone", "call", "mobile", "fax", "card", "ip", "mail", "email", "e-mail"):
        out.append(f"before={before}")
    return out


class SemiMarkov:
    """Types 0..3 and 4 for other words; segments of type 4 are single words."""

    OTHER = 4

    def __init__(self):
        self.number: dict[str, int] = {}
        self.weights = np.zeros((0, 4))
        self.follow = np.zeros((5, 5))

    def encode(self, text: str, words: list[tuple[int, int]], learn: bool = False) -> dict[tuple[int, int], np.ndarray]:
        out = {}
        for low in range(len(words)):
            for high in range(low + 1, min(len(words), low + LONGEST) + 1):
                names = span_features(text, words, low, high)
                if learn:
                    for name in names:
                        self.number.setdefault(name, len(self.number))
                out[low, high] = np.array([self.number[f] for f in names if f in self.number], np.int64)
        return out

    def scores(self, segments: dict) -> dict[tuple[int, int], np.ndarray]:
        return {k: self.weights[v].sum(axis=0) for k, v in segments.items()}

    def _into(self, scores: dict, n: int, join) -> list[np.ndarray]:
        """For each position, a value per type of the segments that end there; join pools over predecessors."""
        at = [np.full(5, -np.inf) for _ in range(n + 1)]
        for high in range(1, n + 1):
            for low in range(max(0, high - LONGEST), high):
                came = self.follow[self.OTHER] if low == 0 else join(at[low][:, None] + self.follow, axis=0)
                for kind in range(4):
                    at[high][kind] = join(np.array([at[high][kind], came[kind] + scores[low, high][kind]]), axis=0)
                if high - low == 1:
                    at[high][4] = join(np.array([at[high][4], came[4]]), axis=0)
        return at

    def decode(self, text: str, words: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
        """The best segmentation's entities: (kind, first word, end word)."""
        n = len(words)
        scores = self.scores(self.encode(text, words))
        best = [[-np.inf] * 5 for _ in range(n + 1)]
        back: list[list] = [[None] * 5 for _ in range(n + 1)]
        follow = self.follow.tolist()
        for high in range(1, n + 1):
            for low in range(max(0, high - LONGEST), high):
                own = [*scores[low, high].tolist(), 0.0 if high - low == 1 else -np.inf]
                for kind in range(5):
                    if own[kind] == -np.inf:
                        continue
                    value, came = (follow[4][kind], None) if low == 0 else max((best[low][k] + follow[k][kind], k) for k in range(5))
                    if value + own[kind] > best[high][kind]:
                        best[high][kind], back[high][kind] = value + own[kind], (low, came)
        out, at = [], n
        kind = max(range(5), key=lambda k: best[n][k])
        while at:
            low, came = back[at][kind]
            if kind < 4:
                out.append((kind, low, at))
            at, kind = low, came
        return out[::-1]

    def fit(self, examples: list[tuple[str, list[tuple[int, int]], list[tuple[int, int, int]]]], rounds: int = ROUNDS, penalty: float = PENALTY):
        """Gradient ascent (AdaGrad) on the conditional log-likelihood of the examples' segmentations."""
        encoded = [(self.encode(t, w, True), len(w), e) for t, w, e in examples]
        self.weights = np.zeros((len(self.number), 4))
        seen_w, seen_f = np.full(self.weights.shape, 1e-6), np.full((5, 5), 1e-6)
        for _ in range(rounds):
            grad_w, grad_f = -penalty * self.weights, -penalty * self.follow
            for segments, n, entities in encoded:
                self._gradient(segments, n, entities, grad_w, grad_f)
            seen_w += grad_w**2
            seen_f += grad_f**2
            self.weights += 0.5 * grad_w / np.sqrt(seen_w)
            self.follow += 0.5 * grad_f / np.sqrt(seen_f)
        return self

    def _gradient(self, segments, n, entities, grad_w, grad_f):
        scores = self.scores(segments)
        forward = self._into(scores, n, np.logaddexp.reduce)
        whole = np.logaddexp.reduce(forward[n])
        after = [np.full(5, -np.inf) for _ in range(n)] + [np.zeros(5)]
        for low in range(n - 1, -1, -1):
            for high in range(low + 1, min(n, low + LONGEST) + 1):
                own = np.append(scores[low, high], 0.0 if high - low == 1 else -np.inf) + after[high]
                chance = (forward[low][:, None] if low else np.array([[-np.inf]] * 4 + [[0.0]])) + self.follow + own - whole
                chance = np.exp(chance)
                grad_f -= chance
                np.subtract.at(grad_w, segments[low, high], chance[:, :4].sum(axis=0))
                after[low] = np.logaddexp(after[low], np.logaddexp.reduce(self.follow + own, axis=1))
        at, came = 0, self.OTHER
        for kind, low, high in [*entities, (None, n, n)]:
            for _ in range(at, low):
                grad_f[came, self.OTHER] += 1
                came = self.OTHER
            if kind is not None:
                grad_f[came, kind] += 1
                np.add.at(grad_w[:, kind], segments[low, high], 1)
                at, came = high, kind


def _as_words(words: list[tuple[int, int]], spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans as runs of words; spans that share a word with an earlier one or are too long are left out."""
    starts, out, last = [s for s, _ in words], [], 0
    for kind, start, end in sorted(spans, key=lambda x: (x[1], -x[2])):
        low = bisect_left(starts, start + 1) - 1
        high = bisect_left(starts, end)
        if low >= last and 0 < high - low <= LONGEST:
            out.append((kind, low, high))
            last = high
    return out


def _rewritten(text: str, start: int, end: int, kind: int) -> list[str]:
    """The span in forms that the patterns miss, and look-alikes that are no entities (kind None is told by the caller)."""
    span = text[start:end]
    if kind == 3:
        short = re.sub(r"^\+[0-9]+[ .-]*", "", span)
        return [short] if len(digits(short)) >= 9 else []
    if kind == 0:
        local, _, domain = span.partition("@")
        plain = re.sub(r"[0-9]", "", local).strip("._%+-") or "info"
        return [
            f"{local} at {domain.replace('.', ' dot ')}",
            f"{plain} at {domain.replace('.', ' dot ')}",
            f"{plain} [at] {re.sub(r'[0-9]', '', domain).replace('.', ' [dot] ')}",
        ]
    return []


def examples_of(texts: list[str]) -> list[tuple]:
    """Regions with their base spans, and rewritten copies with the same truth; look-alikes have none."""
    out = []
    alike = ["2021-03-04", "12345", "3.14", "1,234,567", "10-12", "v1.2.3", "2019/11/02", "1234 5678", "007", "12:30:45", "50%", "at 5 dot 2"]
    for number, text in enumerate(texts):
        spans = base_spans(text)
        for words in regions(text):
            low, high = words[0][0], words[-1][1]
            inside = [s for s in spans if low <= s[1] and s[2] <= high]
            out.append((text, words, _as_words(words, inside)))
            for kind, start, end in inside[:2]:
                for form in _rewritten(text, start, end, kind):
                    copy = f"{text[max(low, start - 40):start]}{form}{text[end:min(high, end + 40)]}"
                    at = start - max(low, start - 40)
                    own = [m.span() for m in _WORD.finditer(copy)]
                    out.append((copy, own, _as_words(own, [(kind, at, at + len(form))])))
        other = text[:40].split()[:1] + [alike[number % len(alike)]] + text[-40:].split()[:1]
        copy = " ".join(other)
        out.append((copy, [m.span() for m in _WORD.finditer(copy)], []))
    return [x for x in out if 0 < len(x[1]) <= LONGEST_REGION]


def fit(
    docs: DataFrame,
    most_texts: int = MOST_TEXTS,
    most_regions: int = MOST_REGIONS,
    regions_a_text: int = REGIONS_A_TEXT,
    longest_region: int = LONGEST_REGION,
) -> SemiMarkov | None:
    """The model, fitted on a sample by hash of the texts that look as if they held base spans."""

    def with_spans(frames):
        for frame in slices(frames, texts="text"):
            out = []
            for t in frame["text"]:
                spans, own = [(s, e) for _, s, e in base_spans(t)], []
                for words in regions(t) if spans else ():
                    low, high = words[0][0], words[-1][1]
                    if len(words) <= longest_region and any(low <= s and e <= high for s, e in spans):
                        own.append(t[low:high])
                    if len(own) == regions_a_text:
                        break
                out += own
            yield pd.DataFrame({"region": pd.Series(out, dtype=object)})

    # what base spans look like, roughly
    like = r"[A-Za-z0-9]@[A-Za-z0-9-]+\.|\+[0-9][0-9 ().-]{8}|[0-9]\.[0-9]+\.[0-9]+\.[0-9]|[0-9]([ -]?[0-9]){12}"
    cues = docs.where("text IS NOT NULL").select(F.col("text").cast("string").alias("text")).where(F.col("text").rlike(like))
    many = cues.count()
    if not many:
        return None
    drawn = cues.where(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < (1 << 30) * min(1.0, most_texts / many))
    found = drawn.mapInPandas(with_spans, "region string").distinct().orderBy(F.xxhash64("region"), "region").limit(most_regions)
    sample = [r["region"] for r in found.collect()]
    return SemiMarkov().fit(examples_of(sample)) if sample else None


class _Taken:
    """Places that spans cover, for one look-up each."""

    def __init__(self, spans):
        self.starts, self.ends = [], []
        for start, end in sorted(spans):
            if self.ends and start <= self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], end)
            else:
                self.starts.append(start)
                self.ends.append(end)

    def meets(self, start: int, end: int) -> bool:
        k = bisect_right(self.ends, start)
        return k < len(self.starts) and self.starts[k] < end


def spans_of(text: str, model: SemiMarkov | None) -> tuple[list, list]:
    """Base spans, and all spans, both by kind and start."""
    base = base_spans(text)
    if model is None:
        return base, base
    taken = _Taken((s, e) for _, s, e in base)
    added = []
    for words in regions(text):
        if all(taken.meets(s, e) or not _SIGN.search(text, s, e) for s, e in words) and not _SPOKEN.search(text, words[0][0], words[-1][1]):
            continue
        for kind, low, high in model.decode(text, words):
            start, end = _trim(text, words[low][0], words[high - 1][1])
            if end > start and not taken.meets(start, end):
                added.append((kind, start, end))
    return base, sorted(base + added)


def show(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


def scan(docs: DataFrame, model: SemiMarkov | None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (all), n_added: one row per row of docs."""
    session = docs.sparkSession
    known = session.sparkContext.broadcast(model)

    def run(frames):
        for frame in slices(frames, texts="text"):
            rows = []
            for doc_id, text in zip(frame["doc_id"], frame["text"]):
                base, every = spans_of(text or "", known.value)
                counts = [sum(k == kind for k, _, _ in base) for kind in range(4)]
                rows.append((doc_id, *counts, hashlib.sha256(show(base).encode()).hexdigest(), show(every), len(every) - len(base)))
            out = pd.DataFrame(rows, columns=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"])
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, schema)


def find(docs: DataFrame, **sample) -> DataFrame:
    return scan(docs, fit(docs, **sample))
