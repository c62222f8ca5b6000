"""Text of table cells and names: reasons, sizes, numbers, escapes and their checks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed patterns
SHA256 = r"^[0-9a-f]{64}\z"
LABEL = r"^[A-Za-z0-9][A-Za-z0-9_.-]*\z"
SIZE = r"^[0-9]+[KM]?\z"
BASES = r"^[ACGTacgt]*\z"

#: Largest granularity.
MOST = 1 << 30


def reason(text: Column) -> Column:
    """A missing value's cell, `n/a — why`; null where no substantive reason is given."""
    bare = F.regexp_replace(F.regexp_replace(text, r"^\s+|\s+$", ""), r"(?i)^n/a(\s*[:—-]\s*|\s+)", "")
    said = (F.length(F.trim(bare)) > 0) & (F.lower(bare) != "n/a")
    return F.when(said, F.concat(F.lit("n/a — "), F.replace(F.replace(bare, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))))


def size_bytes(token: Column, most: int = MOST) -> Column:
    """Bytes of a size such as 64K; null if it is none or beyond 1 to most."""
    unit = F.when(token.endswith("K"), 1024).when(token.endswith("M"), 1024**2).otherwise(1)
    n = F.regexp_extract(token, "^[0-9]{1,10}", 0).try_cast("long") * unit
    return F.when(token.rlike(SIZE) & (F.length(token) <= 11) & n.between(1, most), n)


def size_label(g: Column) -> Column:
    return F.when(g % 1024 == 0, F.concat((g / 1024).cast("long").cast("string"), F.lit(" KiB"))).otherwise(F.concat(g.cast("string"), F.lit(" B")))


def number(x: Column) -> Column:
    """Digits without exponent and without closing zeros, to 18 places; null is empty."""
    s = x.cast("string").cast("decimal(38,18)").cast("string")
    s = F.format_string("%s", s)
    plain = F.regexp_replace(F.when(x == 0, "0").otherwise(s), r"(\.[0-9]*?)0+$", "$1")
    return F.when(x.isNull(), "").otherwise(F.regexp_replace(plain, r"\.$", ""))


def escaped(text: Column) -> Column:
    """A cell that neither Markdown nor HTML reads as markup."""
    # Fixed replacements, in this order
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("|", "&#124;"), ("\n", " "), ("\r", " "), ("[", "&#91;"), ("]", "&#93;"), ("`", "&#96;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def table_id(base: Column, threads: Column, hash_mode: Column, w: Column) -> Column:
    """A table's name: each condition that is known adds its part."""
    part = lambda head, x: F.coalesce(F.concat(F.lit(head), x.cast("string")), F.lit(""))
    return F.concat(base, part("-threads-", threads), part("-hash-", hash_mode), F.concat(F.lit("-W"), F.coalesce(w.cast("string"), F.lit("none"))))


def confined(path: Column) -> Column:
    """A relative path that stays below its root."""
    return F.coalesce((path != "") & ~path.rlike(r"[\\:\x00]") & ~path.startswith("/") & ~path.rlike(r"(^|/)\.\.(/|\z)"), F.lit(False))
