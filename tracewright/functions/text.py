"""Log lines, paths and tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Log type and the pattern that recognises it, first match wins.
LOG_TYPE_PATTERNS = [
    ("vpn", r"openvpn\.log"),
    ("wp-access", r"access\.log"),
    ("wp-error", r"error\.log"),
    ("intranet-error", r"intranet_server/logs/.*error\.log"),
    ("auth", r"auth\.log"),
    ("audit", r"audit\.log"),
    ("dns", r"dnsmasq\.log"),
    ("share", r"internal_share/logs/audit/audit\.log"),
    ("monitor", r"system\.cpu\.log"),
    ("dummy_log", r"dummy_log\.log"),
]

# Types whose pattern is a special case of a more general one.
SPECIFIC_LOG_TYPES = ["intranet-error", "share"]

WORD_RUN = r"[\p{L}\p{Nl}\p{No}_]+"


def log_type(path: Column, strict: bool = False) -> Column:
    """Log type of a path. ``strict`` tries the special cases before the general patterns."""
    patterns = LOG_TYPE_PATTERNS
    if strict:
        patterns = sorted(patterns, key=lambda p: p[0] not in SPECIFIC_LOG_TYPES)
    lowered = F.lower(path)
    kind = None
    for name, pattern in patterns:
        hit = lowered.rlike(pattern)
        kind = F.when(hit, name) if kind is None else kind.when(hit, name)
    return kind.otherwise("unknown")


def tenant(rel_path: Column) -> Column:
    """First folder of a relative path; a file at the top has none."""
    return F.when(rel_path.rlike("^[^/]+/"), F.element_at(F.split(rel_path, "/"), 1)).otherwise("unknown")


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(name: Column) -> Column:
    """Name without its last suffix; a leading dot does not start a suffix."""
    return F.regexp_replace(name, r"(?<=[^.])\.[^.]*$", "")


def suffix(name: Column) -> Column:
    return F.regexp_extract(name, r"[^.](\.[^.]+)$", 1)


def numeric_suffix(name: Column) -> Column:
    return suffix(name).rlike(r"^\.[0-9]+$")


def is_hidden(path: Column) -> Column:
    return F.startswith(file_name(path), F.lit("."))


# Three whitespace-separated tokens at the very start of a line.
HEAD = r"(?U)^(\S+\s+\S+\s+\S+)"

# The characters that count as white space around a text.
WHITE_SPACE = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
               "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITE_SPACE))


def is_blank(text: Column) -> Column:
    return strip(text) == ""


def timestamp_text(line: Column) -> Column:
    """First three tokens as written, or N/A when the line has fewer or starts with a space."""
    head = F.regexp_extract(line, HEAD, 1)
    return F.when(head != "", head).otherwise("N/A")


def message_text(line: Column) -> Column:
    """What follows the timestamp tokens; the whole line if there are none."""
    return strip(F.substring(line, F.length(F.regexp_extract(line, HEAD, 1)) + 1, F.length(line)))


def compact_line(line: Column) -> Column:
    return F.concat_ws("\t", timestamp_text(line), message_text(line))


def event_time(line: Column, year: int) -> Column:
    """Event time of the two line shapes in the logs; the syslog shape carries no year."""
    syslog = F.concat(F.lit(f"{year} "), F.regexp_replace(
        F.regexp_extract(line, r"^([A-Z][a-z]{2}\s+\d+ \d\d:\d\d:\d\d)", 1), r"\s+", " "))
    apache = F.regexp_extract(line, r"^\[[A-Z][a-z]{2} ([A-Z][a-z]{2} \d\d \d\d:\d\d:\d\d\.\d{6} \d{4})\]", 1)
    return F.coalesce(
        F.try_to_timestamp(apache, F.lit("MMM dd HH:mm:ss.SSSSSS yyyy")),
        F.try_to_timestamp(syslog, F.lit("yyyy MMM d HH:mm:ss")),
    )


def tokens(text: Column) -> Column:
    """Lower-cased runs of word characters without digits, 2 to 15 long, not starting with an underscore."""
    runs = F.regexp_extract_all(F.lower(text), F.lit(WORD_RUN), F.lit(0))
    return F.filter(runs, lambda t: F.length(t).between(2, 15) & ~F.startswith(t, F.lit("_")))


def char_ngrams(token: Column, n_min: int = 3, n_max: int = 6) -> Column:
    """Character n-grams of the token between boundary marks."""
    marked = F.concat(F.lit("<"), token, F.lit(">"))

    def of_length(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.length(marked) - (n - 1), F.lit(1)))
        cut = F.transform(starts, lambda i: F.substring(marked, i, F.lit(n)))
        return F.filter(cut, lambda g: F.length(g) == n)

    return F.concat(*[of_length(n) for n in range(n_min, n_max + 1)])


def word_set(text: Column) -> Column:
    words = F.split(F.lower(F.translate(text, "_-", "  ")), r"\s+")
    return F.array_distinct(F.filter(words, lambda w: w != ""))


def md5_prefix(text: Column, n: int = 16) -> Column:
    return F.left(F.md5(text), F.lit(n))
