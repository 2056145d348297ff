"""Transcripts: cleaning, coding, timing and slicing. Every function returns a Column of built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .constants import CODES, GAP_CHAR, GAP_WORD, HOP, MAX_FRAMES, SAMPLE_RATE, SIGNS, VOCABULARY, literal_map, units

OUTSIDE = r"""[^A-Z0-9 .,?'!/():;&=+\-_"$@]"""
#: The same characters named one by one: Java tries a list of ranges some fifteen times as fast as the complement of one.
OUTSIDE_RANGES = r"[\x00-\x1F#%*<>\x5B-\x5E\x60-\x{10FFFF}]"
SPAN = "array<struct<start_u:double,end_u:double,word:string>>"
EVENTS = "array<struct<dur_s:double,is_tone:boolean>>"


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often ``body`` uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def clean_vocab(raw: Column) -> Column:
    """Upper case; what is no sign becomes a space; runs of spaces become one."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.upper(raw), OUTSIDE_RANGES, " "), "  +", " "))


def _lines(raw: Column) -> Column:
    return F.transform(F.split(raw, "\r\n|\n|\r"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))


def clean_bulletin(raw: Column) -> Column:
    """Without the marker lines of bulletins."""
    keep = F.filter(_lines(raw), lambda x: ~x.rlike("^[=<]") & ~x.contains("QST DE W1AW"))
    return clean_vocab(F.array_join(keep, " "))


def clean_book(raw: Column) -> Column:
    """Without the setting lines of books and blank lines."""
    keep = F.filter(_lines(raw), lambda x: ~x.rlike(r"^\*[A-Z]+=") & (x != ""))
    return clean_vocab(F.array_join(keep, " "))


def characters(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def symbols(text: Column) -> Column:
    """Dots and dashes of each sign, ``/`` for a space; unknown characters are left out."""
    table = literal_map({c: CODES[c] for c in SIGNS} | {" ": "/"})
    return F.array_join(F.filter(F.transform(characters(F.upper(text)), lambda c: table[c]), lambda s: s.isNotNull()), " ")


def encode_label(text: Column) -> Column:
    """Vocabulary numbers of the characters; unknown ones are left out."""
    table = literal_map({c: i for i, c in enumerate(VOCABULARY) if len(c) == 1})
    return F.filter(F.transform(characters(text), lambda c: table[c]), lambda i: i.isNotNull())


def _units() -> Column:
    return literal_map({c: units(CODES[c]) for c in SIGNS})


def timing_events(text: Column, wpm: Column | float) -> Column:
    """Tones and gaps as array<struct<dur_s, is_tone>>. The gap after a sign depends on its place in the word, not on what follows."""
    dit = F.lit(1.2) / (F.lit(wpm) if isinstance(wpm, (int, float)) else wpm)
    tones = literal_map({c: CODES[c] for c in SIGNS})

    def event(length: Column, tone: bool) -> Column:
        return F.struct((dit * length).alias("dur_s"), F.lit(tone).alias("is_tone"))

    def sign(code: Column) -> Column:
        marks = characters(code)
        return F.flatten(F.transform(marks, lambda s, i: F.when(i < F.size(marks) - 1, F.array(event(F.when(s == ".", 1.0).otherwise(3.0), True), event(F.lit(1.0), False))).otherwise(F.array(event(F.when(s == ".", 1.0).otherwise(3.0), True)))))

    nothing = F.array().cast(EVENTS)

    def word(w: Column) -> Column:
        chars = characters(w)
        return F.flatten(F.transform(chars, lambda c, i: F.when(tones[c].isNull(), nothing).otherwise(F.concat(sign(tones[c]), F.when(i < F.size(chars) - 1, F.array(event(F.lit(float(GAP_CHAR)), False))).otherwise(nothing)))))

    all_words = words(F.upper(text))
    return F.flatten(F.transform(all_words, lambda w, i: F.concat(word(w), F.when(i < F.size(all_words) - 1, F.array(event(F.lit(float(GAP_WORD)), False))).otherwise(nothing))))


def signal_seconds(text: Column, wpm: Column | float) -> Column:
    return F.aggregate(timing_events(text, wpm), F.lit(0.0), lambda acc, e: acc + e["dur_s"])


def word_units(word: Column) -> Column:
    """Length of one word in units, at least 1; unknown characters are left out first."""
    table = _units()
    known = F.filter(F.transform(characters(F.upper(word)), lambda c: table[c]), lambda u: u.isNotNull())
    return F.greatest(F.aggregate(known, F.lit(0), lambda a, u: a + u) + GAP_CHAR * (F.size(known) - 1), F.lit(1))


def sums_before(values: Column, run: int = 256) -> Column:
    """Of an array of doubles the sum of all before each. It is built in runs: appending to one long array would cost the square of its length."""
    state = "struct<at:double,out:array<double>>"
    first = lambda at: F.struct(at.alias("at"), F.array().cast("array<double>").alias("out")).cast(state)
    put = lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")).cast(state)

    def of(v: Column) -> Column:
        part = lambda k: F.slice(v, k * run + 1, F.lit(run))
        runs = F.sequence(F.lit(0), F.floor((F.size(v) - 1) / run).cast("int"))
        totals = F.transform(runs, lambda k: F.aggregate(part(k), F.lit(0.0), lambda n, x: n + x))
        starts = F.aggregate(totals, first(F.lit(0.0)), put, lambda acc: acc["out"])
        sums = F.flatten(F.transform(starts, lambda at, k: F.aggregate(part(k), first(at), put, lambda acc: acc["out"])))
        return F.when(F.size(v) > 0, sums).otherwise(F.array().cast("array<double>"))

    return let(values, of)


def word_spans(text: Column) -> Column:
    """Start and end of every word in units, a word gap between."""
    def of(ws: Column) -> Column:
        units = F.transform(ws, lambda w: word_units(w).cast("double"))
        starts = lambda u: sums_before(F.transform(u, lambda x: x + float(GAP_WORD)))
        span = lambda u, at: F.transform(ws, lambda w, i: F.struct(F.get(at, i).alias("start_u"), (F.get(at, i) + F.get(u, i)).alias("end_u"), w.alias("word")))
        return let(units, lambda u: let(starts(u), lambda at: span(u, at)))

    return let(words(text), of).cast(SPAN)


def slice_by_fraction(text: Column, frac_s: Column | float, frac_e: Column | float) -> Column:
    """Words whose middle lies in the shrunken window; else those that touch it; else the one nearest to its middle."""
    fs, fe = (F.lit(x) if isinstance(x, (int, float)) else x for x in (frac_s, frac_e))

    def chosen(spans: Column, w: Column) -> Column:
        middle = lambda x: (x["start_u"] + x["end_u"]) / 2
        core = F.filter(spans, lambda x: (middle(x) >= w["low"]) & (middle(x) <= w["high"]))
        touching = F.filter(spans, lambda x: (x["end_u"] > w["start"]) & (x["start_u"] < w["end"]))
        nearest = F.array_min(F.transform(spans, lambda x, i: F.struct(F.abs(middle(x) - (w["start"] + w["end"]) / 2).alias("d"), i.alias("i"), x.alias("x"))))["x"]
        best = F.when(F.size(core) > 0, core).when(F.size(touching) > 0, touching).otherwise(F.array(nearest))
        return F.upper(F.array_join(F.transform(best, lambda x: x["word"]), " "))

    def window(spans: Column) -> Column:
        total = F.element_at(spans, -1)["end_u"]
        start = F.greatest(F.lit(0.0), F.least(fs, F.lit(1.0))) * total
        end = F.greatest(start, F.least(fe, F.lit(1.0)) * total)
        margin = F.least((end - start) * 0.15, total * 0.05)
        low = F.when(fs <= 0.02, start).otherwise(F.least(end, start + margin))
        high = F.when(fe >= 0.98, end).otherwise(F.greatest(start, end - margin))
        return F.struct(start.alias("start"), end.alias("end"), low.alias("low"), high.alias("high"))

    part = let(word_spans(text), lambda spans: let(window(spans), lambda w: chosen(spans, w)))
    return F.when(F.size(words(text)) == 0, F.upper(F.trim(text))).otherwise(part)


def slice_by_chars(text: Column, frac_s: Column | float, frac_e: Column | float) -> Column:
    """Characters between two fractions of the length, without edge spaces."""
    fs, fe = (F.lit(x) if isinstance(x, (int, float)) else x for x in (frac_s, frac_e))
    a = F.floor(fs * F.length(text)).cast("int")
    b = F.floor(fe * F.length(text)).cast("int")
    return F.trim(F.substring(text, a + 1, F.greatest(b - a, F.lit(0))))


def truncate_label(text: Column, n_samples: Column) -> Column:
    """What fits in the longest input, cut at a word's end."""
    frames = F.floor(n_samples / HOP) + 1
    kept = F.greatest(F.lit(1), F.floor(F.length(text) * (MAX_FRAMES * HOP / SAMPLE_RATE) / (n_samples / SAMPLE_RATE)).cast("int"))
    cut = F.substring(text, F.lit(1), kept)
    last = F.when(F.locate(" ", F.reverse(cut)) > 0, F.length(cut) - F.locate(" ", F.reverse(cut))).otherwise(F.lit(-1))
    short = F.when(last > 0, F.substring(cut, F.lit(1), last)).otherwise(F.rtrim(cut))
    return F.when(frames > MAX_FRAMES, short).otherwise(text)


def chars_per_second(wpm: Column) -> Column:
    return wpm * 5.0 / 60.0


def speed_from_name(name: Column, header: Column) -> Column:
    """The largest number of a directory name, else the setting in the first 200 characters, else 20."""
    found = F.transform(F.regexp_extract_all(name, F.lit(r"(\d+)"), F.lit(1)), lambda x: x.cast("double"))
    stated = F.regexp_extract(F.substring(header, 1, 200), r"\*WPM=(\d+)\*", 1)
    return F.coalesce(F.array_max(found), F.when(stated != "", stated.cast("double")), F.lit(20.0))


def character_speed(wpm: Column) -> Column:
    """Slow recordings stretch their gaps; their signs are sent at 15."""
    return F.when(wpm <= 5, F.lit(15.0)).otherwise(wpm)
