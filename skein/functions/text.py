"""Text, time and message functions as Column expressions: no Python runs for a row.

Lengths are bytes of UTF-8 and letter case is that of ASCII, as stored indexes
of other tools have it; `as_of` stands for the present so that results repeat.
"""

from __future__ import annotations

import datetime as dt
import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words that are not marked in results.
STOPWORDS = frozenset(
    "a an and are as at based be but by can check do double for from has have how i in into is it made not of on or please "
    "some that the this to update what with you your".split()
)
#: What marks bookkeeping messages.
COMMAND_MARKS = tuple(f"<command-name>/{c}</command-name>" for c in ("exit", "resume", "clear", "compact"))
CAVEAT_MARKS = ("<local-command-caveat>", "Caveat: The messages below were generated by the user while running local commands.")
EMPTY_PHRASES = ("/exit", "/clear", "/compact", "resume cancelled", "i'll start by studying")
RFC3339 = r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$"


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def strip(c: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def compact(c: Column) -> Column:
    """Words joined by single spaces."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def cut_bytes(c: Column, n: int) -> Column:
    """The longest start of c of whole characters within n bytes: a character has at most four,
    so one of the last four places is a boundary."""
    raw = F.encode(c, "UTF-8")
    inside = lambda at: F.hex(F.substring(raw, at + 1, 1)).between("80", "BF")
    at = F.lit(max(0, n - 3))
    for k in (2, 1, 0):
        at = F.when(~inside(max(0, n - k)), max(0, n - k)).otherwise(at)
    return F.when(F.octet_length(c) <= n, c).otherwise(F.decode(F.substring(raw, F.lit(1), at), "UTF-8"))


def clipped(w: Column, n: int) -> Column:
    """Compact text cut to n bytes, `...` included."""
    return F.when(F.octet_length(w) <= n, w).otherwise(F.concat(cut_bytes(w, n - 3), F.lit("...")))


def truncated(c: Column, n: int) -> Column:
    """Compact text of at most n bytes, `...` included."""
    return clipped(compact(c), n)


def preview_of(w: Column) -> Column:
    """The preview of a compact text."""
    return F.when(w == "", "(no preview available)").otherwise(clipped(w, 140))


def preview(c: Column) -> Column:
    return preview_of(compact(c))


def moment(c: Column) -> Column:
    """RFC 3339 with an offset, or a date (midnight UTC), else null."""
    return F.when(c.rlike(RFC3339) | c.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_timestamp(F.upper(c)))


def days_since(c: Column, as_of: Column) -> Column:
    return F.expr("0") + F.floor(F.abs(F.unix_micros(as_of) - F.unix_micros(c)) / F.lit(86_400_000_000)) * F.signum(F.unix_micros(as_of) - F.unix_micros(c))


def relative_age(c: Column, as_of: Column) -> Column:
    secs = (F.unix_micros(as_of) - F.unix_micros(c)) / 1_000_000
    ago = lambda size, unit: F.concat(F.floor(secs / size).cast("string"), F.lit(unit + " ago"))
    return (
        F.when(c.isNull(), "-").when(secs < 60, "just now").when(secs < 3600, ago(60, "m")).when(secs < 86400, ago(3600, "h"))
        .when(secs < 30 * 86400, ago(86400, "d")).otherwise(F.date_format(c, "yyyy-MM-dd"))
    )


def substantive(c: Column) -> Column:
    """Whether a message says something: not blank, no command bookkeeping, no stock phrase."""
    t = strip(c)
    return (t != "") & ~F.contains(t, F.lit("<local-command-")) & ~F.contains(t, F.lit("<command-name>/")) & ~ascii_lower(t).isin(*EMPTY_PHRASES)


def skipped(c: Column, is_meta: Column) -> Column:
    """Whether a message is a caveat or bookkeeping that transcripts leave out."""
    caveat = F.contains(c, F.lit(CAVEAT_MARKS[0])) | F.contains(c, F.lit(CAVEAT_MARKS[1]))
    marks = F.lit(False)
    for m in COMMAND_MARKS:
        marks = marks | F.contains(c, F.lit(m))
    return (F.coalesce(is_meta, F.lit(False)) & caveat) | marks | (ascii_lower(strip(c)) == "resume cancelled")


def transcript_line(role: Column, ts: Column, text: Column) -> Column:
    stamp = F.coalesce(F.date_format(ts, "yyyy-MM-dd HH:mm:ss 'UTC'"), F.lit("unknown-time"))
    return F.concat(F.lit("["), stamp, F.lit("] "), role, F.lit("\n"), text)


def first_lines(c: Column, n: int) -> Column:
    """The first n lines; a line end at the end of the text begins no line."""
    body = F.regexp_replace(F.regexp_replace(c, "\r\n", "\n"), "[\r\n]$", "")
    return F.lit("") if n <= 0 else F.when(c == "", "").otherwise(F.array_join(F.slice(F.split(body, "\n"), 1, n), "\n"))


def starts_like(c: Column, prefix: str) -> Column:
    """SQL LIKE 'prefix%' without case of ASCII letters; % and _ in the prefix match anything,
    a backslash is itself."""
    own = prefix.translate(str.maketrans(UPPER, LOWER)).replace("\\", "\\\\")
    return ascii_lower(F.coalesce(c, F.lit(""))).like(own + "%")


def highlight_terms(query: str) -> list[str]:
    """What highlighting looks for: the whole query and its longer words, longest first."""
    whole = query.strip()
    terms = [whole] if whole else []
    for token in whole.split():
        low = token.translate(str.maketrans(UPPER, LOWER))
        if len(token.encode()) >= 3 and low not in STOPWORDS and low not in (t.translate(str.maketrans(UPPER, LOWER)) for t in terms):
            terms.append(token)
    return sorted(terms, key=lambda t: -len(t.encode()))


def highlighted(c: Column, query: str) -> Column:
    terms = highlight_terms(query)
    if not terms:
        return c
    pattern = "|".join(re.sub(r"([^\w\s]|_)", r"\\\1", t) for t in terms)
    return F.regexp_replace(c, f"(?iu)({pattern})", "[[$1]]")


def _plain_letters() -> tuple[str, str]:
    """Accented letters of the Latin, Greek and Cyrillic scripts and the letters they are made of, by
    canonical decomposition; then the combining marks themselves, which stand for nothing."""
    pairs = []
    for k in (*range(0xC0, 0x530), *range(0x1E00, 0x2000)):
        base, *marks = unicodedata.normalize("NFD", chr(k))
        if marks and base.isalpha() and all(unicodedata.combining(m) for m in marks):
            pairs.append((chr(k), base))
    marks = "".join(map(chr, range(0x300, 0x370)))
    return "".join(a for a, _ in pairs) + marks, "".join(b for _, b in pairs)


ACCENTED, PLAIN = _plain_letters()
_UNACCENTED = {ord(a): (PLAIN[k] if k < len(PLAIN) else None) for k, a in enumerate(ACCENTED)}


def tokens(c: Column) -> Column:
    """Index terms: runs of letters and digits, lower case, accents stripped."""
    plain = F.translate(F.lower(c), ACCENTED, PLAIN)
    return F.filter(F.split(plain, r"[^\p{L}\p{N}\p{Co}]+"), lambda w: w != "")


def query_terms(query: str) -> list[list[str]]:
    """For each word of a query its index terms: one, or a phrase if signs part it."""
    out = []
    for word in query.split():
        low = word.lower().translate(_UNACCENTED)
        if parts := [p for p in re.split(r"[\W_]+", low) if p]:
            out.append(parts)
    return out


def as_timestamp(value: dt.datetime | str) -> Column:
    return F.lit(str(value)).cast("timestamp")
