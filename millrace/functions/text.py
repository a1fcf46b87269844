"""Text functions: hashing, tokens, links, chunks, snippets, titles, prompts and model replies."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

def _folds() -> tuple[str, str]:
    """Small letters of the Latin blocks that decompose into one of a to z and marks, and those letters."""
    pairs = [(c, unicodedata.normalize("NFD", c)) for c in map(chr, (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)))]
    kept = [(c, d[0]) for c, d in pairs if c == c.lower() and len(d) > 1 and d[0].isascii() and d[0].isalpha() and all(map(unicodedata.combining, d[1:]))]
    return "".join(c for c, _ in kept), "".join(d for _, d in kept)


ACCENTED, PLAIN = _folds()
TOKEN = r"[\p{L}\p{N}]+"


def collapsed(text: Column) -> Column:
    """Runs of Unicode white space as one blank, ends stripped."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def normalized_hash(body: Column) -> Column:
    return F.sha2(collapsed(F.lower(body)), 256)


def raw_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def normalized_title(title: Column) -> Column:
    return F.nullif(collapsed(F.lower(title)), F.lit(""))


def folded(text: Column) -> Column:
    return F.translate(F.lower(text), ACCENTED, PLAIN)


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(folded(text), F.lit(TOKEN), F.lit(0))


def sanitized(query: Column) -> Column:
    """A search query without anything but word characters and white space."""
    return F.trim(F.regexp_replace(query, r"(?U)[^\w\s]", " "))


def wikilinks(body: Column) -> Column:
    return F.transform(F.regexp_extract_all(body, F.lit(r"\[\[([^\]\n]+)\]\]"), F.lit(1)), lambda x: F.trim(x))


def all_links(links: Column, body: Column) -> Column:
    return F.array_sort(F.array_union(F.coalesce(links, F.array().cast("array<string>")), wikilinks(body)))


def chunks(text: Column, most: int = 2048) -> Column:
    """Greedy packing of paragraphs into chunks of at most `most` characters; longer paragraphs are cut."""
    paragraphs = F.filter(F.transform(F.split(text, "\n\n"), lambda p: F.trim(p, F.lit(" \n\t\r"))), lambda p: p != "")
    none = F.array().cast("array<string>")

    def flushed(acc: Column) -> Column:
        return F.when(acc["open"] != "", F.array_append(acc["done"], acc["open"])).otherwise(acc["done"])

    def step(acc: Column, p: Column) -> Column:
        joined = F.when(acc["open"] == "", p).otherwise(F.concat(acc["open"], F.lit("\n\n"), p))
        cuts = F.transform(F.sequence(F.lit(0), F.floor((F.char_length(p) - 1) / most).cast("int")), lambda i: F.substring(p, i * most + 1, F.lit(most)))
        oversize = F.struct(F.concat(flushed(acc), cuts).alias("done"), F.lit("").alias("open"))
        full = F.struct(flushed(acc).alias("done"), p.alias("open"))
        fits = F.struct(acc["done"].alias("done"), joined.alias("open"))
        return F.when(F.char_length(p) > most, oversize).when(F.char_length(joined) > most, full).otherwise(fits)

    packed = F.aggregate(paragraphs, F.struct(none.alias("done"), F.lit("").alias("open")), step, flushed)
    whole = F.trim(text, F.lit(" \n\t\r"))
    return F.when(whole == "", none).when(F.char_length(text) <= most, F.array(whole)).otherwise(packed)


def snippet(body: Column, most: int = 240) -> Column:
    flat = collapsed(body)
    return F.when(F.char_length(flat) > most, F.concat(F.rtrim(F.substring(flat, 1, most)), F.lit("…"))).otherwise(flat)


def word_count(body: Column) -> Column:
    return F.size(F.filter(F.split(body, r"(?U)\s+"), lambda w: w != ""))


def turn_count(body: Column) -> Column:
    """Lines that begin with a role marker."""
    return F.regexp_count(body, F.lit(r"(?m)^[^\S\n]*\*\*(?:User|Assistant):\*\*"))


def h1_title(body: Column) -> Column:
    """Text of the first level-one heading anywhere, or null."""
    return F.nullif(F.regexp_extract(body, r"(?m)^#\s+(.+?)\s*$", 1), F.lit(""))


def leading_title(body: Column) -> Column:
    """Text of the first non-blank line if that is a level-one heading, or null."""
    return F.nullif(F.trim(F.regexp_extract(body, r"^\s*# ([^\n]*)", 1)), F.lit(""))


def _with_commas(n: Column) -> Column:
    return F.format_number(n, 0)


def truncated_middle(text: Column, most: int) -> Column:
    """Three quarters of the budget from the head and one from the tail, around a marker."""
    tail = most // 4
    cut = F.concat(
        F.substring(text, 1, most - tail),
        F.lit("\n\n[… "),
        _with_commas(F.char_length(text) - most),
        F.lit(" characters left out here …]\n\n"),
        F.right(text, F.lit(tail)),
    )
    return F.when(F.char_length(text) <= most, text).otherwise(cut)


def truncated_head(text: Column, most: int) -> Column:
    cut = F.concat(F.substring(text, 1, most), F.lit("\n\n[… "), _with_commas(F.char_length(text) - most), F.lit(" more characters]"))
    return F.when(F.char_length(text) <= most, text).otherwise(cut)


def without_fences(text: Column) -> Column:
    """A model's reply without surrounding code fences."""
    flat = F.trim(text, F.lit(" \n\t\r"))
    inner = F.trim(F.regexp_extract(flat, r"(?s)^```[^\n]*\n(?:(.*)\n)?[^\n]*```$", 1), F.lit(" \n\t\r"))
    return F.when(flat.rlike(r"(?s)^```[^\n]*\n.*```$"), inner).otherwise(flat)


def parsed_score(reply: Column) -> Column:
    """A reply's score of 0 to 100 as 0 to 1: a JSON field, else the first integer, else 0."""
    flat = F.trim(reply, F.lit(" \n\t\r"))
    field = F.when(flat.startswith("{"), F.get_json_object(flat, "$.score").try_cast("double"))
    number = F.regexp_extract(flat, r"-?\d+", 0).try_cast("double")
    score = F.coalesce(field, number, F.lit(0.0)) / 100.0
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def expands(query: Column) -> Column:
    """Whether a query is a question worth expanding rather than a look-up."""
    q = F.trim(query, F.lit(" \n\t\r"))
    # Shapes of exact look-ups.
    exact = (
        r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
        r"^[0-9a-fA-F]{32,}$",
        r"^[/~][\w./~\-]+$|^[\w\-]+/[\w./\-]+$",
        r'"[^"]+"',
        r"\b(AND|OR|NOT)\b",
        r"(^|\s)[+-]\w",
    )
    shaped = F.lit(False)
    for pattern in exact:
        shaped = shaped | q.rlike(pattern)
    return F.coalesce((q != "") & ~shaped & (F.size(F.split(q, r"\s+")) >= 3), F.lit(False))


def image_refs(body: Column) -> Column:
    """Local image files that a body embeds, Markdown before HTML, each once."""
    markdown = F.regexp_extract_all(body, F.lit(r"!\[[^\]]*\]\(([^)\s]+)[^)]*\)"), F.lit(1))
    html = F.regexp_extract_all(body, F.lit(r"""(?i)<img[^>]+src=["']([^"']+)["']"""), F.lit(1))
    local = F.filter(F.concat(markdown, html), lambda r: ~r.rlike(r"^(?:https?://|data:)") & r.rlike(r"(?i)\.(?:png|jpe?g|gif|webp|bmp)$"))
    return F.array_distinct(local)


def data_url(content: Column, path: Column) -> Column:
    """An image file's bytes as a data URL."""
    # Media types by extension.
    kinds = {"jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "webp": "image/webp", "bmp": "image/bmp"}
    extension = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    mime = F.lit("image/png")
    for suffix, kind in kinds.items():
        mime = F.when(extension == suffix, F.lit(kind)).otherwise(mime)
    return F.concat(F.lit("data:"), mime, F.lit(";base64,"), F.base64(content))


def cwd_slug(cwd: Column) -> Column:
    """A working directory as a project tag."""
    flat = F.regexp_replace(F.replace(F.trim(cwd, F.lit("/")), F.lit("/"), F.lit("-")), r"[^A-Za-z0-9._-]+", "-")
    return F.trim(flat, F.lit("-"))


def iso_week(when: Column) -> Column:
    return F.format_string("%d-W%02d", F.extract(F.lit("YEAROFWEEK"), when).cast("int"), F.weekofyear(when))


def uuid5(namespace: str, name: Column) -> Column:
    """Version-5 UUID of a name."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex((F.conv(F.substring(digest, 17, 1), 16, 10).cast("int").bitwiseAND(F.lit(3))).bitwiseOR(F.lit(8))))
    return F.concat_ws("-", F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.concat(F.lit("5"), F.substring(digest, 14, 3)), F.concat(variant, F.substring(digest, 18, 3)), F.substring(digest, 21, 12))


def matches_expectation(needles: Column, title: Column, body: Column, path: Column) -> Column:
    """Whether any needle occurs, ignoring case, in the title, body or path."""
    return F.exists(needles, lambda s: F.contains(F.lower(title), F.lower(s)) | F.contains(F.lower(body), F.lower(s)) | F.contains(F.lower(path), F.lower(s)))
