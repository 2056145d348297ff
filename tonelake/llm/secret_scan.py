"""Secrets in texts, with built-in expressions only: fixed patterns, and a battery of randomness tests.

Every run of 20 or more token characters is a candidate. Its encoding is inferred from its characters (hexadecimal, one
case of letters, letters and digits of one case, or the 64-letter alphabet). Three tests of randomness are made over that alphabet:
chi-squared of the symbol counts against equal shares, the runs above and below the middle of the alphabet, and the serial correlation
of neighbouring symbols. Whether a token is too even to be words is a fourth question: for words the same chi-squared is far larger,
by an amount that grows with the length, so its lower tail under that law is a p-value that falls with length.

All four meet in one false-discovery control, the weighted Benjamini-Hochberg rule over all candidates of the table: the p-value
against words is divided by a weight of at most 1, the joint p-value of the three tests of randomness. A token that is not random in
counts, runs or correlation so needs the more evidence against words; a long token can bring it, a short one cannot. The cut is taken from
a histogram of the logarithms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, unused

#: Fixed patterns, in the order of their kinds; matches shorter than the given length are dropped.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_HINT = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]"""
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]{24,}"
CANDIDATE = "[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "random")

DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: name, pattern, symbols in order, and the share of equal pairs of symbols that words in this alphabet have.
ENCODINGS = (
    ("hex", "^([0-9a-f]+|[0-9A-F]+)$", DIGITS + "abcdef", 0.20),
    ("letters", "^([a-z]+|[A-Z]+|[A-Z][a-z]+)$", LOWER, 0.068),
    ("base36", "^([a-z0-9]+|[A-Z0-9]+)$", DIGITS + LOWER, 0.068),
    ("base64", "", UPPER + LOWER + DIGITS + "+/", 0.060),
)
LEAST_P = 1e-300
FALSE_DISCOVERY = 0.01
BINS_PER_DECADE = 50

_SPAN = "struct<s:int,k:int,e:int>"
_FOUND = "struct<s:int,e:int,m:string>"
#: Matches that are placed in one go; the work for a text then grows with its matches, not with their square.
_RUN = 256


def _none() -> Column:
    return F.array().cast(f"array<{_SPAN}>")


def _let(value: Column, then) -> Column:
    """``then`` of a value that is computed once, though it is used in several places."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _located(text: Column, pattern: str) -> Column:
    """Matches of a pattern as array<struct<s, e, m>>; positions are code points. What stands between the matches gives them."""
    found = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"))
    none = F.array().cast(f"array<{_FOUND}>")
    size = lambda x: F.length(x["gap"]) + F.length(x["m"])

    def step(acc: Column, x: Column) -> Column:
        start, end = acc["at"] + F.length(x["gap"]), acc["at"] + size(x)
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("s"), end.alias("e"), x["m"].alias("m")))).alias("out")).cast(f"struct<at:int,out:array<{_FOUND}>>")

    def placed(pairs: Column) -> Column:
        runs = F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / _RUN).cast("int"))
        run = lambda k: F.slice(pairs, k * _RUN + 1, F.lit(_RUN))
        empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        begin = lambda acc, k: F.struct(F.aggregate(run(k), acc["at"], lambda n, x: n + size(x)).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")).cast("struct<at:int,out:array<int>>")
        starts = F.aggregate(runs, empty.cast("struct<at:int,out:array<int>>"), begin, lambda acc: acc["out"])
        first = lambda at: F.struct(at.alias("at"), none.alias("out")).cast(f"struct<at:int,out:array<{_FOUND}>>")
        return F.flatten(F.transform(starts, lambda at, k: F.aggregate(run(k), first(at), step, lambda acc: acc["out"])))

    return _let(F.filter(found, lambda x: x["m"].isNotNull()), lambda pairs: F.when(F.size(pairs) > 0, placed(pairs)).otherwise(none))


def _spans(found: Column, kind: int, keep) -> Column:
    return F.transform(F.filter(found, keep), lambda x: F.struct(x["s"].alias("s"), F.lit(kind).alias("k"), x["e"].alias("e"))).cast(f"array<{_SPAN}>")


def base_spans(text: Column) -> Column:
    """Spans of the fixed patterns, array<struct<s, k, e>> with k a place in KINDS."""
    value = F.regexp_extract  # the value of an assignment is what its last group takes
    assign = F.when(text.rlike(ASSIGN_HINT), _spans(_located(text, ASSIGN), 0, lambda x: F.length(value(x["m"], ASSIGN, 2)) >= 6)).otherwise(_none())
    access = F.when(text.contains("AKIA"), _spans(_located(text, ACCESS), 1, lambda x: F.length(x["m"]) >= 20)).otherwise(_none())
    hexes = F.when(text.rlike(HEX), _spans(_located(text, HEX), 2, lambda x: F.lit(True))).otherwise(_none())
    return F.concat(assign, access, hexes)


def candidates(text: Column) -> Column:
    """Runs of token characters: array<struct<s, e, m>>."""
    return F.when(text.rlike(CANDIDATE), _located(text, CANDIDATE)).otherwise(F.array().cast(f"array<{_FOUND}>"))


def normal_cdf(z: Column) -> Column:
    """Standard normal distribution function, by a rational approximation good to 1e-7 and positive in the lower tail."""
    t = 1 / (1 + 0.2316419 * F.abs(z))
    tail = F.exp(-z * z / 2) * 0.3989422804 * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.when(z < 0, tail).otherwise(1 - tail)


def _p_even(chi: Column, free: int) -> Column:
    """Two-sided: symbol counts too uneven or too even. The cube root of a chi-squared over its freedom is close to normal."""
    z = (F.cbrt(F.greatest(chi, F.lit(0.0)) / free) - (1 - 2 / (9 * free))) / (2 / (9 * free)) ** 0.5
    return 2 * (1 - normal_cdf(F.abs(z)))


def _p_runs(bits: Column, n: Column) -> Column:
    """Runs of symbols of the lower and the upper half of the alphabet."""
    high = F.length(F.replace(bits, F.lit("0"), F.lit(""))).cast("double")
    mean = 2 * high * (n - high) / n + 1
    spread = F.sqrt((mean - 1) * (mean - 2) / (n - 1))
    return F.when((high == 0) | (high == n) | (spread <= 0), F.lit(0.0)).otherwise(2 * (1 - normal_cdf(F.abs((F.regexp_count(bits, F.lit("0+|1+")) - mean) / spread))))


def _p_serial(values: Column, n: Column) -> Column:
    """Correlation of neighbouring symbols' places in the alphabet."""

    def around(moved: Column) -> Column:
        power = F.aggregate(moved, F.lit(0.0), lambda a, v: a + v * v)
        steps = F.zip_with(F.slice(moved, F.lit(1), F.size(moved) - 1), F.slice(moved, F.lit(2), F.size(moved) - 1), lambda a, b: a * b)
        serial = F.aggregate(steps, F.lit(0.0), lambda a, v: a + v)
        return _let(power, lambda w: F.when(w <= 0, F.lit(0.0)).otherwise(2 * (1 - normal_cdf(F.abs((serial / w + 1 / n) * F.sqrt(n))))))

    return _let(F.aggregate(values, F.lit(0.0), lambda a, v: a + v) / n, lambda centre: _let(F.transform(values, lambda v: v - centre), around))


def _tests(token: Column, symbols: str, pairs: float) -> Column:
    """p-value against words over the weight that the three tests of randomness give, at most 1."""
    m, free = len(symbols), len(symbols) - 1

    def of(word: Column) -> Column:
        n = F.length(word).cast("double")
        squares = F.aggregate(F.array_distinct(F.split(word, "")), F.lit(0.0), lambda acc, s: acc + F.pow(n - F.length(F.replace(word, s, F.lit(""))), F.lit(2.0)))
        bits = F.translate(word, symbols, "0" * (m // 2) + "1" * (m - m // 2))
        values = F.transform(F.split(word, ""), lambda c: F.position(c, F.lit(symbols)).cast("double"))
        # noncentral chi-squared of words: mean and variance grow with the length
        shift = m * pairs - 1
        p_words = lambda chi: normal_cdf((chi - (free + n * shift)) / F.sqrt(2 * free + 4 * n * shift))
        # the joint p-value of the three tests (Bonferroni)
        least = lambda chi: F.least(_p_even(chi, free), _let(bits, lambda x: _p_runs(x, n)), _let(values, lambda x: _p_serial(x, n)))
        weight = lambda chi: F.greatest(F.least(3 * least(chi), F.lit(1.0)), F.lit(LEAST_P))
        return _let(squares * m / n - n, lambda chi: F.least(F.greatest(p_words(chi), F.lit(LEAST_P)) / weight(chi), F.lit(1.0)))

    return _let(F.lower(token) if symbols.islower() or symbols[0] == "0" else F.translate(token, "-_=", "+//"), of)


def p_value(token: Column) -> Column:
    """The battery over the inferred encoding."""
    out = None
    for name, pattern, symbols, pairs in ENCODINGS:
        tests = _tests(token, symbols, pairs)
        if name == "base64":
            return out.otherwise(tests)
        out = F.when(token.rlike(pattern), tests) if out is None else out.when(token.rlike(pattern), tests)
    return out


def _bin(p: Column) -> Column:
    return F.floor(-F.log10(p) * BINS_PER_DECADE).cast("int")


def discovery_cut(scanned: DataFrame, rate: float = FALSE_DISCOVERY) -> int:
    """The smallest bin of -log10(p) that the Benjamini-Hochberg rule rejects."""
    tests = scanned.select(F.explode("tokens").alias("t")).select("t.p")
    rows = tests.groupBy(_bin(F.col("p")).alias("bin")).agg(F.count("*").alias("n")).collect()  # at most 300 * BINS_PER_DECADE rows
    total, seen, cut = sum(r["n"] for r in rows), 0, 1 << 30
    for r in sorted(rows, key=lambda r: -r["bin"]):
        seen += r["n"]
        if 10 ** (-r["bin"] / BINS_PER_DECADE) <= rate * seen / total:
            cut = r["bin"]
    return cut


def scan(docs: DataFrame, text: str = "text", rate: float = FALSE_DISCOVERY, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all, if not given) of every row, and ``secret_spans``: array<struct<s, k, e>> in order, k a place in KINDS.

    A random token inside a span of the fixed patterns adds nothing. Null and empty texts have no spans; very long ones are read
    whole. Null ids, ties and repeated rows are rows like any other, an empty table gives none. An input column named ``secret_spans`` is
    replaced; all other names are free. Rows are scanned once and written to the shared folder with what was found.
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() != "secret_spans"]
    base, tokens = unused("base", keep), unused("tokens", keep)
    found = docs.select(*keep, base_spans(body).alias(base), candidates(body).alias(tokens))
    tested = F.transform(tokens, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), p_value(x["m"]).alias("p")))
    scanned = stored(found.select(*keep, base, tested.alias(tokens)))
    cut = discovery_cut(scanned.select(F.col(tokens).alias("tokens")), rate)
    good = F.filter(tokens, lambda t: (_bin(t["p"]) >= cut) & ~F.exists(base, lambda b: (b["s"] <= t["s"]) & (b["e"] >= t["e"])))
    more = F.transform(good, lambda t: F.struct(t["s"].alias("s"), F.lit(3).alias("k"), t["e"].alias("e"))).cast(f"array<{_SPAN}>")
    return scanned.select(*keep, F.array_sort(F.concat(base, more)).alias("secret_spans"))


def named(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    kind = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(kind, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with every stretch that spans cover replaced by a mark; overlapping spans are one stretch."""
    state = "struct<at:int,out:string>"

    def step(acc: Column, x: Column) -> Column:
        fresh = x["s"] >= acc["at"]
        out = F.when(fresh, F.concat(acc["out"], F.substring(text, acc["at"] + 1, x["s"] - acc["at"]), F.lit(mark))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], x["e"]).alias("at"), out.alias("out")).cast(state)

    first = F.struct(F.lit(0).alias("at"), F.lit("").alias("out")).cast(state)
    return F.when(F.size(spans) > 0, F.aggregate(spans, first, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))).otherwise(text)
