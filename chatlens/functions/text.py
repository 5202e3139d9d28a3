"""Text expressions: length rule, video key, capitalising, display texts."""

from pyspark.sql import functions as F

from chatlens.schema import MIN_CHARS_EXCLUSIVE

TERM_SEPARATOR = r"[^\p{L}\p{M}]+"


def long_enough(df, column="message"):
    """More code points than the minimum; a missing text never qualifies.

    Tables written by chatlens.plans.layout carry n_chars, so the test reaches
    the Parquet scan and panels need not read the text at all.
    """
    chars = F.col("n_chars") if "n_chars" in df.columns else F.length(column)
    return chars > MIN_CHARS_EXCLUSIVE


def video_key(url):
    """What stands between the first and the second '=' of a URL, else NULL."""
    return F.try_element_at(F.split(url, "="), F.lit(2))


def capitalised(column):
    """First character upper case, all others lower case (not word by word)."""
    c = F.col(column) if isinstance(column, str) else column
    return F.concat(F.upper(F.left(c, F.lit(1))), F.lower(F.substr(c, F.lit(2))))


def named(column, names):
    """Value looked up in a small dict; anything else gives NULL."""
    c = F.col(column) if isinstance(column, str) else column
    out = F.lit(None).cast("string")
    for value, name in names.items():
        out = F.when(c == value, F.lit(name)).otherwise(out)
    return out


def share_text(n, pct, total=None):
    """'n (p%)', or 'n of N (p%)' when a total is given."""
    if total is None:
        return F.format_string("%d (%.1f%%)", n, pct)
    return F.format_string("%d of %d (%.1f%%)", n, total, pct)


def terms(column):
    """Lower-case words of a text, any script."""
    return F.split(F.lower(column), TERM_SEPARATOR)
