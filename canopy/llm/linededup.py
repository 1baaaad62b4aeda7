"""Removal of repeated runs of lines, found by winnowing over line hashes.

Two kinds of line are hashed. Physical lines of at least LINE_WORDS words each stand for themselves. Passages that start
or end in mid-line need smaller ones: a text is also cut behind every sentence end and behind every word whose hash says
so (one in four), and since such a cut depends on the word alone, two copies have the same cuts. Of these parts, grams of
consecutive ones with at least `gram_words` words are hashed, and every window of `window_words` words gives its smallest
hash as fingerprint. So two texts that share a run of so many words in whole parts share a fingerprint of it, and two
equal physical lines share theirs.

A fingerprint's occurrences join the first of them only, in order of (doc_id, text hash, position), never each other. That
loses nothing: what a fingerprint stands for is itself long enough to go. A match is extended both ways as far as the two
texts have the same words, whatever blanks and line ends are between them. It is cut out of the later text if it has `gram_words` words, or if it has whole
physical lines, one of LINE_WORDS words among them, which are cut then. Shorter repetitions stay: they are headings,
phrases and the common stock of a language, and holes in the middle of a line would hurt more than they save. The first
occurrence of a passage always stays. Of a passage that an earlier text has as well, `window_words` words in whole parts
never stay in full.

A word is a run of non-blank characters; one of more than LONG_WORD characters counts as several, so that scripts without
blanks are measured too. Null texts stay null and have no lines. Rows equal in doc_id and text count as one document and
are treated alike, so neither empties the other; rows that share only the doc_id, or have none, are documents of their
own (a null id comes first). Documents with nothing repeated come back unchanged, and a text that is wholly a repetition
becomes empty; rows are never dropped. Other columns are kept as they are, whatever their names, but n_chars follows the
text, and a column named like one of the report's gives way to it. An empty table gives no rows.
"""

from __future__ import annotations

import re
from bisect import bisect_left

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopy.llm.common import ROWS, doc_key, drop_table, fresh, materialize, named, slices
from canopy.llm.words import BASE, hashed_words, mixed, powers

GRAM_WORDS, WINDOW_WORDS, LINE_WORDS = 20, 40, 12
LONG_WORD = 16
#: Later texts that meet a first text in one group.
GROUP = 256
_WORD = re.compile(r"\S+")
#: By code point: blanks, and marks that end a sentence.
_BLANK = np.array([chr(c).isspace() for c in range(0x3002)])
_END = np.array([chr(c) in ".!?;:" for c in range(128)])
_INVERSE = pow(BASE, -1, 2**64)


def _runs(hashes: np.ndarray, low: np.ndarray, high: np.ndarray, up: np.ndarray, down: np.ndarray) -> np.ndarray:
    """Hash of every run of words low..high, by prefix sums of a polynomial modulo 2^64."""
    sums = np.concatenate(([np.uint64(0)], np.cumsum(hashes * up[: len(hashes)], dtype=np.uint64)))
    return mixed((sums[high] - sums[low]) * down[low] + (high - low).astype(np.uint64))


def fingerprints(texts: list[str], gram_words: int, window_words: int, line_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of the text, hash, start) of every line of line_words words and of the least gram of every window.

    A gram is the fewest parts from its first one on that have gram_words words; a window, the grams that lie within the
    fewest parts with window_words words. Of equal grams in a window the last is taken, and while a chosen one is near an
    equal one is not added, so that monotonous texts have few fingerprints. The texts are laid end to end, with a line
    end between; no line, part, gram or window runs over it.
    """
    none = np.zeros(0, np.int64)
    size = np.array([len(t) for t in texts], np.int64)
    first = np.concatenate(([0], np.cumsum(size + 1)))
    points = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    starts, ends, hashes = hashed_words(points, _BLANK[np.minimum(points, len(_BLANK) - 1)])
    n = len(starts)
    if not n:
        return none, none, none
    until = np.concatenate(([0], np.cumsum((ends - starts + LONG_WORD - 1) // LONG_WORD)))
    text_of = np.searchsorted(first, starts, side="right") - 1
    up, down = powers(BASE, n), powers(_INVERSE, n)
    # lines: runs of words between line ends
    line = np.unique(np.concatenate(([0], np.searchsorted(starts, np.flatnonzero(points == 10)), [n])))
    long = np.flatnonzero(until[line[1:]] - until[line[:-1]] >= line_words)
    lines = mixed(_runs(hashes, line[long], line[long + 1], up, down) + np.uint64(1))
    # parts: from word `low` to before word `high`
    cut = (hashes >> np.uint64(40)) % np.uint64(4) == 0
    cut |= _END[np.minimum(points[ends - 1], len(_END) - 1)]
    cut[line[1:] - 1] = True
    high = np.flatnonzero(cut) + 1
    low = np.concatenate(([0], high[:-1]))
    of, begin, end = text_of[low], until[low], until[high]
    parts = len(low)
    reach = np.searchsorted(end, begin + gram_words)  # the part that fills the gram from a part on
    whole = (reach < parts) & (of[np.minimum(reach, parts - 1)] == of)
    grams = np.zeros(parts, np.uint64)
    at = np.flatnonzero(whole)
    grams[at] = _runs(hashes, low[at], high[reach[at]], up, down)
    most = np.searchsorted(end, begin + window_words)
    full = whole & (most < parts) & (of[np.minimum(most, parts - 1)] == of)
    # a text of less than a window has one
    full[whole & np.concatenate(([True], of[1:] != of[:-1]))] = True
    final = np.searchsorted(of, of, side="right") - 1
    place = np.arange(parts)
    to = np.maximum(np.searchsorted(reach, np.minimum(most, final), side="right"), place + 1)
    best, held = place.copy(), grams.copy()
    for step in range(1, int((to - place)[full].max(initial=1))):
        better = np.flatnonzero((place[:-step] + step < to[:-step]) & (grams[step:] <= held[:-step]))
        best[better] = better + step
        held[better] = grams[better + step]
    chosen = np.unique(best[full])
    if len(chosen):
        own, since = grams[chosen], begin[chosen].tolist()
        same = np.flatnonzero((own[1:] == own[:-1]) & (of[chosen[1:]] == of[chosen[:-1]])) + 1
        keep = np.ones(len(chosen), bool)
        for k in same.tolist():
            if since[k] - since[k - 1] < window_words - gram_words:
                keep[k], since[k] = False, since[k - 1]
        chosen = chosen[keep]
    word = np.concatenate((line[long], low[chosen]))
    text = text_of[word]
    return text, np.concatenate((lines, grams[chosen])).view(np.int64), starts[word] - first[text]


def _fingerprint_rows(gram_words, window_words, line_words):
    def run(frames):
        for frame in slices(frames, ROWS, "text"):
            text, fp, at = fingerprints(frame["text"].tolist(), gram_words, window_words, line_words)
            yield pd.DataFrame({"fp": fp, "doc": frame["doc"].to_numpy()[text], "hash": frame["hash"].to_numpy()[text], "at": at})

    return run


class _Text:
    """A text's words and where they stand."""

    def __init__(self, text: str):
        found = list(_WORD.finditer(text))
        self.text, self.words = text, [m[0] for m in found]
        self.starts, self.ends = [m.start() for m in found], [m.end() for m in found]


def _agree(a: list[str], i: int, b: list[str], j: int) -> int:
    """How many words from a[i] and b[j] on are the same, by slices of growing and then shrinking size."""
    done, step, most = 0, 16, min(len(a) - i, len(b) - j)
    while done + step <= most and a[i + done : i + done + step] == b[j + done : j + done + step]:
        done += step
        step *= 2
    while step > 1:
        step //= 2
        if done + step <= most and a[i + done : i + done + step] == b[j + done : j + done + step]:
            done += step
    return done


def _agree_before(a: list[str], i: int, b: list[str], j: int) -> int:
    """How many words before a[i] and b[j] are the same."""
    done, step, most = 0, 16, min(i, j)
    while done + step <= most and a[i - done - step : i - done] == b[j - done - step : j - done]:
        done += step
        step *= 2
    while step > 1:
        step //= 2
        if done + step <= most and a[i - done - step : i - done] == b[j - done - step : j - done]:
            done += step
    return done


def _count(words: list[str]) -> int:
    return sum((len(w) + LONG_WORD - 1) // LONG_WORD for w in words)


def shared_runs(first: _Text, later: _Text, places: list[tuple[int, int]], gram_words: int, line_words: int) -> list[tuple[int, int]]:
    """Runs (start, end) of later around the places (there, in first) that first has as well and that are long enough to go."""
    out, reached, text = [], {}, later.text
    for at, there in sorted(places):
        i, j = bisect_left(later.starts, at), bisect_left(first.starts, there)
        if i < reached.get(i - j, 0):
            continue
        high = i + _agree(later.words, i, first.words, j)
        low = i - _agree_before(later.words, i, first.words, j)
        reached[i - j] = high
        if high <= low:
            continue
        start, end = later.starts[low], later.ends[high - 1]
        if _count(later.words[low:high]) < gram_words:
            # whole lines: from the first line start on, to the last line end
            if text[text.rfind("\n", 0, start) + 1 : start].strip():
                start = text.find("\n", start, end) + 1 or end
            stop = text.find("\n", end)
            if text[end : stop if stop >= 0 else len(text)].strip():
                end = max(start, text.rfind("\n", start, end))
            if not any(_count(row.split()) >= line_words for row in text[start:end].split("\n")):
                continue
            # blanks around stay, to keep apart what is left
            end = start + len(text[start:end].rstrip())
            start = end - len(text[start:end].lstrip())
        out.append((start, end))
    return out


def _run_rows(gram_words, line_words):
    """Texts come in groups behind the first text that they match."""

    def run(frames):
        first = None
        for frame in slices(frames):
            rows = []
            for r in frame.itertuples(index=False):
                if r.leads:
                    first = _Text(r.text)
                    continue
                places = list(zip(r.here.tolist(), r.there.tolist()))
                rows += [(r.doc, r.hash, s, e) for s, e in shared_runs(first, _Text(r.text), places, gram_words, line_words)]
            yield pd.DataFrame(rows, columns=["doc", "hash", "start", "end"], dtype="int64")

    return run


def cut_runs(text: str, runs) -> str:
    """The text without the runs; a line that they leave blank goes as well."""
    out, at = [], 0
    for start, end in sorted((int(r["start"]), int(r["end"])) for r in runs):
        if start > at:
            out.append(text[at:start])
        at = max(at, end)
    out.append(text[at:])
    out = [x for x in out if x.strip()] or [""]
    for k in range(1, len(out)):
        if out[k - 1][-1:] == "\n":
            out[k] = out[k].lstrip("\n")
        elif out[k - 1][-1:].isspace() and out[k][:1] == " ":
            out[k] = out[k][1:]
    return "".join(out)


def _cut(text: pd.Series, runs: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else cut_runs(t, r) for t, r in zip(text, runs)], dtype=object)


def repeated_runs(
    docs: DataFrame, gram_words: int = GRAM_WORDS, window_words: int = WINDOW_WORDS, line_words: int = LINE_WORDS
) -> DataFrame:
    """doc, hash, runs: the runs (start, end in characters) that each document repeats from an earlier place."""
    texts = docs.where("text IS NOT NULL").select(doc_key().alias("doc"), F.xxhash64("text").alias("hash"), "text")
    every = texts.mapInPandas(_fingerprint_rows(gram_words, window_words, line_words), "fp long, doc long, hash long, at long")
    every = materialize(every)
    # most fingerprints occur once: only the others go on. What a join reads is written first, so that Spark can split a
    # frequent fingerprint's rows; it is a merge at every size, since a broadcast would have no bound
    often = materialize(every.groupBy("fp").agg(F.count("*").alias("n")).where("n > 1").select("fp"))
    fps = materialize(every.hint("merge").join(often, "fp"))
    drop_table(every, often)
    place = F.struct("doc", "hash", "at")
    firsts = materialize(fps.groupBy("fp").agg(F.min(place).alias("first")))
    matches = fps.hint("merge").join(firsts, "fp").where(place > F.col("first"))
    pairs = matches.groupBy(
        "doc", "hash", F.col("first.doc").alias("first_doc"), F.col("first.hash").alias("first_hash")
    ).agg(F.collect_list("at").alias("here"), F.collect_list("first.at").alias("there"))
    pairs = materialize(pairs)
    drop_table(fps, firsts)
    # texts are fetched once, for both sides; a first text that many others match is dealt to several groups with it
    key = ["first_doc", "first_hash"]
    sized = materialize(pairs.groupBy(*key).agg(F.ceil(F.count("*") / GROUP).alias("groups")))
    later = pairs.hint("merge").join(sized, key).select(
        "doc", "hash", *key, F.pmod(F.xxhash64("doc", "hash"), "groups").alias("group"), F.lit(False).alias("leads"), "here", "there"
    )
    none = F.lit(None).cast("array<long>")
    leading = sized.select(
        F.col("first_doc").alias("doc"),
        F.col("first_hash").alias("hash"),
        *key,
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1)).alias("group"),
        F.lit(True).alias("leads"),
        none.alias("here"),
        none.alias("there"),
    )
    both = later.unionByName(leading).hint("merge").join(texts, ["doc", "hash"])
    runs = (
        both.repartition(*key, "group")
        .sortWithinPartitions(*key, "group", F.desc("leads"))
        .select("doc", "hash", "text", *key, "leads", "here", "there")
        .mapInPandas(_run_rows(gram_words, line_words), "doc long, hash long, start long, end long")
    )
    return runs.groupBy("doc", "hash").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("runs"))


def remove_repeats(
    docs: DataFrame,
    gram_words: int = GRAM_WORDS,
    window_words: int = WINDOW_WORDS,
    line_words: int = LINE_WORDS,
    report: bool = False,
) -> DataFrame:
    """docs with the repeated runs cut out of text; with report, also removed_runs ("start:end", comma-joined) and n_removed."""
    doc, own, runs, new = fresh(docs, "_doc", "_hash", "_runs", "_text")
    found = materialize(repeated_runs(docs, gram_words, window_words, line_words))
    found = found.select(F.col("doc").alias(doc), F.col("hash").alias(own), F.col("runs").alias(runs))
    keyed = docs.withColumns({doc: doc_key(), own: F.xxhash64("text")})
    joined = keyed.hint("merge").join(found, [doc, own], "left")
    hit = F.col(runs).isNotNull()
    cut = F.pandas_udf(_cut, "string")(F.when(hit, F.col("text")), F.when(hit, F.col(runs)))
    joined = joined.withColumn(new, F.when(hit, cut).otherwise(F.col("text")))

    def shown(name: str):
        if name == "text":
            return F.col(new).alias("text")
        if name == "n_chars":
            return F.when(hit, F.length(new).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")).alias("n_chars")
        return named(name)

    if not report:
        return joined.select(*map(shown, docs.columns))
    return joined.select(
        *(shown(c) for c in docs.columns if c.lower() not in ("n_removed", "removed_runs")),
        F.coalesce(F.size(runs), F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce(F.array_join(F.transform(runs, lambda r: F.concat_ws(":", r["start"], r["end"])), ","), F.lit("")).alias("removed_runs"),
    )
