"""Secret scans by a randomness test battery, in DataFrame functions alone.

Three patterns give base spans. Beside them, every run of at least LEAST_LENGTH key characters outside the assignments
found, and without a base span of the other kinds inside, is a candidate. Its encoding is inferred from its characters
(decimal, hex, base32, base64), and three tests are made on the values of its symbols: chi-squared against a uniform
alphabet, runs of symbols of one kind (upper case, lower case, digits, marks), and serial correlation at lag one.

Each test gives two p-values. One is the chance that random symbols are as far from what randomness predicts; the three
are combined (Fisher), and a candidate with less than KEEP is no key. The other is the chance that text is as near to it.
Text is taken to repeat symbols as letters in prose do (an index of coincidence of TEXT_IC, or half as much again as chance
in small alphabets), to change the kind of its symbols at TEXT_CHANGES of its places, and to have a serial correlation
that scatters by TEXT_SERIAL around none. The three are combined in the same way, and the combination goes through
Benjamini-Hochberg at FDR within strata of encoding and length, where every candidate counts as a test, those that are no
keys with a p-value of one. So short tokens must be more striking where most tokens of their length are words, and long
ones get through among any number of them. The step-up works on a histogram: counts by stratum and bin cover all
candidates of the corpus, and no stratum is ever sorted or gathered.

A text's positions are running sums of the lengths between marks that one pass of a pattern sets. They are taken in two
levels, blocks and within, so that the work grows with the matches and not with their square.

Null and empty texts have no spans (null counts as empty). Positions are code points, ends exclusive. Rows are kept one
for one, repeated ones too; extra columns don't matter. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canopy.llm.common import materialize

# The three base patterns and the least lengths of what they must match.
ASSIGN = r"""((?i:(?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = {"assign": 12, "access": 18, "hex": 16}
KIND_ORDER = [*KINDS, "random"]

LEAST_LENGTH, KEEP, FDR = 20, 0.001, 0.01
TEXT_IC, TEXT_CHANGES, TEXT_SERIAL = 0.066, 1 / 3, 0.3
BINS = 400
#: Lengths are summed in blocks of so many.
BLOCK = 64
_MARK = "\x01"
_BASE64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_SPANS = "array<struct<start:int,rank:int,end:int>>"
# Of each encoding: how many symbols, its alphabet, and the places at which random symbols change their kind.
_ENCODINGS = {
    "decimal": (10, "0123456789", 0.0),
    "hex": (16, "0123456789abcdef", 2 * 10 * 6 / 16**2),
    "base32": (32, _BASE32, 2 * 26 * 6 / 32**2),
    "base64": (64, _BASE64, 1 - (26**2 + 26**2 + 10**2 + 2**2) / 64**2),
}


def _let(value: Column, body) -> Column:
    """body of a value that is worked out once: a lambda that used the expression itself would do so for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _sums(lengths: Column) -> Column:
    """For every length, the sum of those before it."""
    zero = F.lit(0)
    add = lambda held, x: F.struct((held["at"] + x).alias("at"), F.array_append(held["out"], held["at"]).alias("out"))
    none = F.array().cast("array<int>")
    running = lambda values, start: F.aggregate(values, F.struct(start.alias("at"), none.alias("out")), add, lambda held: held["out"])

    def in_blocks(x: Column) -> Column:
        blocks = F.sequence(zero, F.greatest(F.ceil(F.size(x) / BLOCK).cast("int") - 1, zero))
        return F.transform(blocks, lambda b: F.slice(x, b * BLOCK + 1, BLOCK))

    def of_blocks(parts: Column) -> Column:
        totals = F.transform(parts, lambda p: F.aggregate(p, zero, lambda a, x: a + x))
        return F.flatten(F.zip_with(parts, running(totals, zero), running))

    return _let(_let(lengths, in_blocks), of_blocks)


def _every(values: Column, step: int, first: int) -> Column:
    """values[first], values[first + step], ..."""
    return F.filter(values, lambda x, k: k % step == first)


def _marked(text: Column, pattern: str, shown: str) -> Column:
    """The text cut at the marks that stand around every match."""
    return F.split(F.regexp_replace(text, F.lit(pattern), F.lit(shown)), F.lit(_MARK), F.lit(-1))


def _spans(pieces: Column, starts: Column, rank: int) -> Column:
    """Spans of pieces that alternate between gap and match."""
    places, words = _every(starts, 2, 1), _every(pieces, 2, 1)
    return F.zip_with(
        places, words, lambda s, w: F.struct(s.alias("start"), F.lit(rank).alias("rank"), (s + F.length(w)).alias("end"))
    )


def base_spans(docs: DataFrame) -> DataFrame:
    """doc_id, row_no, base spans of each kind, and the candidate tokens with their spans, for every row."""
    own = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # the mark itself matches nothing in any pattern, nor does what stands in for it
    own = F.when(F.contains(own, F.lit(_MARK)), F.translate(own, _MARK, "\x02")).otherwise(own)
    rows = docs.select(F.monotonically_increasing_id().alias("row_no"), F.col("doc_id").cast("long").alias("doc_id"), own.alias("text"))
    # of a run, all that is left of it from the first AKIA on counts, hence the least length can be in the pattern
    access, hexes = r"AKIA[A-Z0-9]{14,}", r"[0-9a-f]{16,}"
    token = rf"[A-Za-z0-9+/_=-]{{{LEAST_LENGTH},}}"
    whole = f"{_MARK}$0{_MARK}"
    rows = rows.withColumns(
        {
            "assigned": _marked(F.col("text"), ASSIGN, f"{_MARK}$1{_MARK}$2{_MARK}"),
            "accessed": _marked(F.col("text"), access, whole),
            "hexed": _marked(F.col("text"), hexes, whole),
        }
    )
    none = F.array().cast(_SPANS)
    starts = lambda pieces: _sums(F.transform(pieces, F.length))
    found = lambda name, made: F.when(F.size(name) > 1, made).otherwise(none)
    # gap, name and sign, value: spans whose value is long enough, and the text with these blanked out
    triples = F.arrays_zip(_every(starts(F.col("assigned")), 3, 1), _every(F.col("assigned"), 3, 1), _every(F.col("assigned"), 3, 2))
    assign = F.transform(
        F.filter(triples, lambda t: F.length(t["2"]) >= KINDS["assign"]),
        lambda t: F.struct(t["0"].alias("start"), F.lit(0).alias("rank"), (t["0"] + F.length(t["1"]) + F.length(t["2"])).alias("end")),
    )
    # behind the last gap there is no name and no value
    blanked = F.transform(
        F.arrays_zip(_every(F.col("assigned"), 3, 0), _every(F.col("assigned"), 3, 1), _every(F.col("assigned"), 3, 2)),
        lambda t: F.concat_ws(
            "",
            t["0"],
            F.when(F.length(t["2"]) >= KINDS["assign"], F.repeat(F.lit(" "), F.length(t["1"]) + F.length(t["2"]))).otherwise(F.concat(t["1"], t["2"])),
        ),
    )
    blanked = F.array_join(blanked, "")
    rows = rows.select(
        "row_no",
        "doc_id",
        found("assigned", assign).alias("assign"),
        found("accessed", _spans(F.col("accessed"), starts(F.col("accessed")), 1)).alias("access"),
        found("hexed", _spans(F.col("hexed"), starts(F.col("hexed")), 2)).alias("hex"),
        _marked(F.when(F.size("assigned") > 1, blanked).otherwise(F.col("text")), token, whole).alias("pieces"),
    )
    pairs = F.zip_with(_spans(F.col("pieces"), starts(F.col("pieces")), 3), _every(F.col("pieces"), 2, 1), lambda s, w: F.struct(s.alias("span"), w.alias("word")))
    pairs = F.filter(pairs, lambda p: ~p["word"].rlike(access) & ~p["word"].rlike(hexes))
    tokens = F.when(F.size("pieces") > 1, pairs).otherwise(F.array().cast("array<struct<span:struct<start:int,rank:int,end:int>,word:string>>"))
    return rows.select("row_no", "doc_id", "assign", "access", "hex", tokens.alias("tokens"))


def _tail(z: Column) -> Column:
    """Upper tail of the normal distribution, by a logistic approximation."""
    z = F.least(F.greatest(z, F.lit(-12.0)), F.lit(12.0))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(1.5976 * z + 0.07056 * z * z * z))


def _both(z: Column) -> Column:
    return F.least(F.lit(1.0), 2 * _tail(F.abs(z)))


def combined(*p: Column) -> Column:
    """Fisher's combination of three p-values: the tail of chi-squared with six degrees of freedom."""
    half = sum((-F.log(F.greatest(x, F.lit(1e-30))) for x in p), F.lit(0.0))
    return F.least(F.lit(1.0), F.exp(-half) * (1 + half + half * half / 2))


def battery(tokens: DataFrame) -> DataFrame:
    """tokens(word, ...) with encoding, n, and the p-values of the three tests and of their combination.

    p_chi, p_runs, p_serial and p_random are chances under randomness, t_chi, t_runs, t_serial and p_text under text.
    """
    body = F.rtrim(F.translate("word", "-_", "+/"), F.lit("="))
    encoding = (
        F.when(F.col("body").rlike("^[0-9]+$"), "decimal")
        .when(F.col("body").rlike("^([0-9a-f]+|[0-9A-F]+)$"), "hex")
        .when(F.col("body").rlike("^[A-Z2-7]+$"), "base32")
        .otherwise("base64")
    )

    def by_encoding(place: int) -> Column:
        *others, last = [(name, F.lit(values[place])) for name, values in _ENCODINGS.items()]
        out = last[1]
        for name, value in others:
            out = F.when(F.col("encoding") == name, value).otherwise(out)
        return out

    rows = tokens.withColumn("body", body).where("length(body) > 3").withColumn("encoding", encoding)
    rows = rows.withColumns(
        {
            "k": by_encoding(0).cast("double"),
            "alphabet": by_encoding(1),
            "changes": by_encoding(2),
            "symbols": F.split(F.when(F.col("encoding") == "hex", F.lower("body")).otherwise(F.col("body")), ""),
        }
    )
    kind = lambda c: F.when((c >= "0") & (c <= "9"), 0).when((c >= "A") & (c <= "Z"), 1).when((c >= "a") & (c <= "z"), 2).otherwise(3)
    rows = rows.withColumns(
        {
            "values": F.transform("symbols", lambda c: (F.instr(F.col("alphabet"), c) - 1).cast("double")),
            "kinds": F.transform("symbols", kind),
        }
    )
    rows = rows.withColumns({"n": F.size("values").cast("double"), "mean": F.aggregate("values", F.lit(0.0), lambda a, v: a + v) / F.size("values")})
    total = lambda array, f: F.aggregate(array, F.lit(0.0), lambda a, v: a + f(v))
    after = lambda name: F.zip_with(F.slice(name, 1, F.size(name) - 1), F.slice(name, 2, F.size(name) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    centred = lambda v: v - F.col("mean")
    rows = rows.withColumns(
        {
            # counts of the symbols, from those present: at most 64
            "squares": total(F.array_distinct("values"), lambda v: F.pow(F.size(F.filter("values", lambda x: x == v)), F.lit(2.0))),
            "changed": total(after("kinds"), lambda p: F.when(p["a"] != p["b"], 1.0).otherwise(0.0)),
            "lagged": total(after("values"), lambda p: centred(p["a"]) * centred(p["b"])),
            "spread": total("values", lambda v: centred(v) * centred(v)),
        }
    )
    n, k, places, rate = F.col("n"), F.col("k"), F.col("n") - 1, F.col("changes")
    chi = k / n * F.col("squares") - n
    ic = F.greatest(F.lit(TEXT_IC), 1.5 / k)
    cube = 1.2 * ic * ic
    text_mean = n + n * (n - 1) * ic
    text_sd = F.sqrt(2 * n * (n - 1) * (ic - ic * ic) + 4 * n * (n - 1) * (n - 2) * (cube - ic * ic))
    # symbols of one kind alone have no runs to test
    slow = F.least(F.lit(TEXT_CHANGES), rate / 2)
    runs = lambda p, z: F.when(rate > 0, p(z)).otherwise(F.lit(1.0))
    serial = F.col("lagged") / F.col("spread") + 1 / n
    held = rows.select(
        *tokens.columns,
        "encoding",
        n.cast("int").alias("n"),
        _tail((chi - (k - 1)) / F.sqrt(2 * (k - 1) * (1 - 1 / n))).alias("p_chi"),
        runs(_both, (F.col("changed") - places * rate) / F.sqrt(F.greatest(places * rate * (1 - rate), F.lit(1e-12)))).alias("p_runs"),
        F.when(F.col("spread") <= 0, 0.0).otherwise(_both(serial * F.sqrt(n))).alias("p_serial"),
        _tail((text_mean - F.col("squares")) / text_sd).alias("t_chi"),
        runs(_tail, (F.col("changed") - 0.5 - places * slow) / F.sqrt(F.greatest(places * slow * (1 - slow), F.lit(1e-12)))).alias("t_runs"),
        F.when(F.col("spread") <= 0, 1.0).otherwise(1 - _both(serial / F.sqrt(1 / n + TEXT_SERIAL**2))).alias("t_serial"),
    )
    return held.withColumns({"p_random": combined(F.col("p_chi"), F.col("p_runs"), F.col("p_serial")), "p_text": combined(F.col("t_chi"), F.col("t_runs"), F.col("t_serial"))})


def discoveries(tested: DataFrame, fdr: float = FDR, keep: float = KEEP) -> DataFrame:
    """The candidates that look random and that Benjamini-Hochberg takes for no text, within encoding and length."""
    stratum = F.least(F.floor(F.log2("n") * 2), F.lit(30)).cast("int")
    bin = F.least(F.lit(BINS), F.floor(-10 * F.log10(F.greatest("p_text", F.lit(1e-40)))).cast("int"))
    binned = tested.withColumns({"stratum": stratum, "bin": F.when(F.col("p_random") >= keep, bin).otherwise(0)})
    # every candidate is a test. At most 4 x 31 x 401 rows
    counts = binned.groupBy("encoding", "stratum", "bin").agg(F.count("*").alias("tests"))
    of = Window.partitionBy("encoding", "stratum")
    ranked = counts.withColumns({"rank": F.sum("tests").over(of.orderBy(F.desc("bin"))), "all": F.sum("tests").over(of)})
    passing = ranked.where((F.col("bin") > 0) & (F.pow(F.lit(10.0), -F.col("bin") / 10) <= fdr * F.col("rank") / F.col("all")))
    least = passing.groupBy("encoding", "stratum").agg(F.min("bin").alias("least"))
    return binned.join(F.broadcast(least), ["encoding", "stratum"]).where(F.col("bin") >= F.col("least"))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random: one row per row of docs."""
    found = materialize(base_spans(docs))
    candidates = found.where("size(tokens) > 0").select("row_no", F.explode("tokens").alias("t")).select("row_no", "t.*")
    secrets = discoveries(materialize(battery(candidates)))
    added = secrets.groupBy("row_no").agg(F.collect_list("span").alias("random"))
    out = found.join(added, "row_no", "left")
    out = out.withColumns({"base": F.array_sort(F.concat("assign", "access", "hex")), "random": F.coalesce("random", F.array().cast(_SPANS))})
    names = F.array(*map(F.lit, KIND_ORDER))
    show = lambda spans: F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["rank"] + 1), s["start"], s["end"])), ","
    )
    count = lambda c: F.size(c).cast("long")
    return out.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(show(F.col("base")), 256).alias("base_sha256"),
        show(F.array_sort(F.concat("base", "random"))).alias("spans"),
        count("random").alias("n_random"),
    )
