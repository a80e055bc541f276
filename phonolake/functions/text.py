"""Text, code and time expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]+"


def tokens(text: Column) -> Column:
    """Lower-case word tokens with curly apostrophes unified."""
    return F.regexp_extract_all(F.lower(F.replace(text, F.lit("’"), F.lit("'"))), F.lit(WORD), F.lit(0))


def upper_each(text: Column) -> Column:
    """Upper case code point by code point: one that has no single capital (ß) stays, so that no letter becomes two."""
    return F.array_join(F.transform(F.split(text, ""), lambda c: F.when(F.length(F.upper(c)) == 1, F.upper(c)).otherwise(c)), "")


def reading_key(text: Column) -> Column:
    """Tokens joined without spaces, so that spacing alone is no difference; 'alright' reads 'all right'."""
    return F.array_join(tokens(F.regexp_replace(F.lower(text), r"\balright\b", "all right")), "")


def artist_identity(song: Column) -> Column:
    """Part before ' - ', folded, without the featured guest."""
    lead = F.lower(F.split_part(song, F.lit(" - "), F.lit(1)))
    return F.regexp_replace(lead, r"\s+(feat\.?|ft\.?|featuring)\s+[\s\S]*$", "")


def contains_in_order(shorter: Column, longer: Column) -> Column:
    """Every token of ``shorter`` occurs in ``longer`` in the same order.

    The shorter list rides along in the fold's state, so it is computed once per row and not once per step.
    """
    zero = F.struct(F.lit(0).alias("at"), shorter.alias("old"))
    done = F.aggregate(
        longer, zero,
        lambda s, token: F.struct(
            F.when(F.get(s["old"], s["at"]) == token, s["at"] + 1).otherwise(s["at"]).alias("at"), s["old"].alias("old")
        ),
        lambda s: s["at"] == F.size(s["old"]),
    )
    return done


def added_words_supported(old: Column, words: Column) -> Column:
    """Walk the candidate's words: each must continue the old reading or be at least 50 % probable."""
    flat = F.flatten(
        F.transform(words, lambda w: F.transform(tokens(w["word"]), lambda t: F.struct(t.alias("t"), w["p"].alias("p"))))
    )
    zero = F.struct(F.lit(0).alias("at"), F.lit(True).alias("ok"), old.alias("old"))

    def step(s, x):
        hit = F.coalesce(F.get(s["old"], s["at"]) == x["t"], F.lit(False))
        return F.struct(
            F.when(hit, s["at"] + 1).otherwise(s["at"]).alias("at"),
            (s["ok"] & (hit | (x["p"] >= 0.5))).alias("ok"),
            s["old"].alias("old"),
        )

    return F.aggregate(flat, zero, step, lambda s: s["ok"] & (s["at"] == F.size(s["old"])))


def is_stage_annotation(text: Column) -> Column:
    """'[music]', '(applause)', '♪ …' and the like; sung 'music' is kept."""
    only = F.array_join(tokens(text), " ")
    return F.trim(text).rlike(r"^[\[(♪♫]") & only.isin("music", "instrumental", "silence", "applause")


def collapse_spaces(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def safe_file_name(value: Column) -> Column:
    """A name every common file system accepts."""
    named = F.when(F.trim(value) == "", "Audio CD").otherwise(F.coalesce(F.trim(value), F.lit("Audio CD")))
    cleaned = F.regexp_replace(named, r'[\x00-\x1f"<>|:*?\\/]', "_")
    cut = F.regexp_replace(F.substring(F.regexp_replace(cleaned, r"[. ]+$", ""), 1, 96), r"[. ]+$", "")
    filled = F.when(F.trim(cut) == "", "Track").otherwise(cut)
    # Names that address devices whatever their extension.
    reserved = r"(?i)^(CON|PRN|AUX|NUL|COM[1-9]|LPT[1-9]) *(\.[\s\S]*)?$"
    return F.when(filled.rlike(reserved), F.concat(F.lit("_"), filled)).otherwise(filled)


def cue_escape(value: Column) -> Column:
    """Quotes and control characters cannot leave the quoted string of a sheet."""
    text = F.when(F.trim(F.coalesce(value, F.lit(""))) == "", "Audio CD").otherwise(value)
    return F.trim(F.regexp_replace(F.replace(text, F.lit('"'), F.lit("'")), r"[\x00-\x1f\x7f]", " "))


def isrc(value: Column) -> Column:
    """Twelve-character form, or empty when it is not one."""
    cleaned = F.upper(F.regexp_replace(value, "[^A-Za-z0-9]", ""))
    return F.when(cleaned.rlike("^[A-Z]{2}[A-Z0-9]{3}[0-9]{7}$"), cleaned).otherwise("")


def isrc_advance(seed: Column, steps: Column) -> Column:
    code = isrc(seed)
    following = F.substring(code, 8, 5).cast("long") + steps
    return F.when(
        (code != "") & (steps >= 0) & (following <= 99999),
        F.concat(F.substring(code, 1, 7), F.lpad(following.cast("string"), 5, "0")),
    ).otherwise("")


def upc(value: Column) -> Column:
    """Thirteen digits with a valid check digit; twelve are led by a zero; otherwise empty."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    full = F.when(F.length(digits) == 12, F.concat(F.lit("0"), digits)).when(F.length(digits) == 13, digits)
    numbers = F.transform(F.split(full, ""), lambda c: c.cast("int"))
    weighted = F.aggregate(
        F.transform(F.slice(numbers, 1, 12), lambda x, i: x * F.when(i % 2 == 0, 1).otherwise(3)),
        F.lit(0), lambda a, x: a + x,
    )
    check = (10 - weighted % 10) % 10
    return F.when(full.isNotNull() & (check == F.get(numbers, F.lit(12))), full).otherwise("")


def two(x: Column, width: int = 2) -> Column:
    """Zero-padded number that is never cut when it has more digits."""
    text = x.cast("string")
    return F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, "0"))


def cd_time(frames: Column) -> Column:
    """mm:ss:ff at 75 frames per second."""
    return F.concat_ws(
        ":", two(F.floor(frames / 4500)), two(F.floor(frames / 75) % 60), two(frames % 75)
    )


def milliseconds(seconds: Column) -> Column:
    """Half away from zero."""
    return F.floor(F.abs(seconds) * 1000 + 0.5).cast("long") * F.signum(seconds).cast("long")


def srt_time(seconds: Column) -> Column:
    ms = milliseconds(seconds)
    return F.concat(
        two(F.floor(ms / 3600000)), F.lit(":"), two(F.floor(ms / 60000) % 60), F.lit(":"),
        two(F.floor(ms / 1000) % 60), F.lit(","), two(ms % 1000, 3),
    )


def clock_time(seconds: Column) -> Column:
    """h:mm:ss.mmm"""
    ms = milliseconds(seconds)
    return F.concat(
        F.floor(ms / 3600000).cast("string"), F.lit(":"), two(F.floor(ms / 60000) % 60), F.lit(":"),
        two(F.floor(ms / 1000) % 60), F.lit("."), two(ms % 1000, 3),
    )


def lrc_time(seconds: Column) -> Column:
    cs = F.floor(seconds * 100 + 0.5).cast("long")
    return F.concat(
        F.lit("["), two(F.floor(cs / 6000)), F.lit(":"), two(F.floor(cs / 100) % 60), F.lit("."), two(cs % 100), F.lit("]")
    )


def clock_seconds(text: Column) -> Column:
    """'mm:ss', 'h:mm:ss' or plain seconds, folded base 60; NULL when a part is no number."""
    parts = F.split(text, ":")
    number = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)\s*$"
    values = F.transform(parts, lambda p: F.when(p.rlike(number), p).cast("double"))
    return F.aggregate(values, F.lit(0.0), lambda a, p: a * 60 + p)


def sector_of(sample: Column, rate: int, length: Column, is_end: bool = False) -> Column:
    """Compact-disc sector of a source position: half away from zero, rounded up only at the document's end."""
    sectors = sample * 44100.0 / rate / 588.0
    rounded = F.floor(sectors + 0.5)
    if is_end:
        rounded = F.when(sample >= length, F.ceil(sectors)).otherwise(rounded)
    return F.when(sample <= 0, 0).otherwise(rounded).cast("long")


def sample_range(start: Column, end: Column, rate: int, frames: Column) -> Column:
    """struct(from, to, ok): at most 100 ms past the end is allowed and cut."""
    a, b = F.bround(start * rate, 0).cast("long"), F.bround(end * rate, 0).cast("long")
    ok = (a >= 0) & (a < frames) & (b > a) & (b <= frames + round(0.1 * rate))
    return F.struct(a.alias("from"), F.least(b, frames).alias("to"), ok.alias("ok"))


def fnv1a(text: Column) -> Column:
    """Stable 31-bit FNV-1a over the two bytes of each character."""
    # Offset basis, prime and masks.
    basis, prime, mask = F.lit(2166136261).cast("long"), F.lit(16777619).cast("long"), F.lit(4294967295).cast("long")
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    octets = F.flatten(F.transform(codes, lambda c: F.array(c % 256, F.floor(c / 256).cast("long"))))
    folded = F.aggregate(octets, basis, lambda h, x: (h.bitwiseXOR(x) * prime).bitwiseAND(mask))
    return folded.bitwiseAND(F.lit(2147483647).cast("long"))


def fingerprint(columns: dict[str, Column]) -> Column:
    """SHA-256 of the row as JSON with keys in sorted order."""
    return F.sha2(F.to_json(F.struct(*[columns[k].alias(k) for k in sorted(columns)])), 256)


def note_name(hz: Column) -> Column:
    """struct(note, cents) relative to A4 = 440 Hz."""
    names = F.array(*[F.lit(n) for n in ("C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B")])
    midi = 69 + 12 * F.log2(hz / 440.0)
    nearest = F.bround(midi, 0).cast("int")
    name = F.concat(F.element_at(names, F.pmod(nearest, F.lit(12)) + 1), (F.floor(nearest / 12) - 1).cast("string"))
    return F.struct(name.alias("note"), F.bround((midi - nearest) * 100, 0).cast("int").alias("cents"))


def find_pattern(find: str, match_case: bool = False, whole_words: bool = True) -> str:
    """Java expression for a literal search. White space in ``find`` stands for any white space. A whole-word search that
    begins (ends) with a letter may not continue a word to its left (right), not even across an apostrophe."""
    parts = ["\\Q" + part.replace("\\E", "\\E\\\\E\\Q") + "\\E" for part in find.split()]
    body = r"\s+".join(parts)
    letter = r"[\p{L}\p{M}\p{N}_]"
    if whole_words and find[:1].isalnum():
        body = rf"(?<!{letter})(?<!{letter}['’])" + body
    if whole_words and find[-1:].isalnum():
        body += rf"(?!['’]?{letter})"
    return body if match_case else "(?iu)" + body


def apply_replacement(text: Column, before: Column, after: Column) -> Column:
    """The previewed text where the line still reads as it did; the line itself where someone changed it since."""
    return F.when(text == before, after).otherwise(text)


def undo_replacement(text: Column, before: Column, after: Column) -> Column:
    """The earlier text where the replacement still stands unchanged."""
    return F.when(text == after, before).otherwise(text)


def replace_preview(text: Column, find: str, replacement: str, **options) -> Column:
    """struct(before, after, changed): ``changed`` counts matches that differ from the replacement."""
    pattern = find_pattern(find, **options)
    safe = replacement.replace("\\", "\\\\").replace("$", "\\$")
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.struct(
        text.alias("before"), F.regexp_replace(text, pattern, safe).alias("after"),
        F.size(F.filter(matches, lambda m: m != replacement)).cast("long").alias("changed"),
    )
