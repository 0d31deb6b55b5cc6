"""Column functions over text: cleaning, slugs, ids, term sets, excerpts. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from groundmesh.config import Config

#: Unicode white space as a regular-expression class.
WS = r"[\s\x0B\x1C-\x1F\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"
TERM = r"[\p{L}\p{N}_\u0900-\u097F]+"
EXCERPT_CHARS, EXCERPT_STOP = 1000, 700
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


def text(c: Column) -> Column:
    """A null counts as the empty text."""
    return F.coalesce(c.cast("string"), F.lit(""))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{WS}+|{WS}+$", "")


def clean_text(c: Column) -> Column:
    """No-break blanks to blanks, zero-width characters out, white space collapsed, ends trimmed."""
    plain = F.regexp_replace(F.translate(text(c), "\u00a0", " "), r"[\u200B-\u200D\uFEFF]", "")
    return F.trim(F.regexp_replace(plain, f"{WS}+", " "))


def slug(c: Column, default: str = "unknown", cleaned: bool = False) -> Column:
    """``cleaned``: c is clean text already."""
    made = F.trim(F.regexp_replace(F.lower(text(c) if cleaned else clean_text(c)), "[^a-z0-9]+", "-"), F.lit("-"))
    return F.coalesce(F.nullif(made, F.lit("")), F.lit(default))


def concept_id(c: Column, cleaned: bool = False) -> Column:
    return slug(c, "unknown", cleaned)


def terms(c: Column) -> Column:
    """All terms in order, repeats kept."""
    return F.regexp_extract_all(F.lower(text(c)), F.lit(TERM), F.lit(0))


def term_set(c: Column) -> Column:
    return F.array_distinct(terms(c))


def query_terms(c: Column, cfg: Config) -> Column:
    listed = F.array(*(F.lit(t) for t in cfg.operational_terms)) if cfg.operational_terms else F.array().cast("array<string>")
    return F.filter(term_set(c), lambda t: (F.length(t) > 2) | F.array_contains(listed, t))


def contains_any(c: Column, phrases: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for p in phrases:
        found = found | F.contains(c, F.lit(p))
    return found


def infer_type(title: Column, content: Column, cfg: Config) -> Column:
    whole = F.lower(F.concat(text(title), F.lit(" "), text(content)))
    return F.when(contains_any(whole, cfg.risk_terms), "risk").when(contains_any(whole, cfg.procedure_terms), "procedure").otherwise("concept")


def stable_id(*parts: Column) -> Column:
    """First 32 hex digits of the SHA-1 of the parts joined by a bar."""
    return F.substring(F.sha1(F.concat_ws("|", *(text(p) for p in parts))), 1, 32)


def uuid5(name: Column) -> Column:
    """UUID version 5 in the URL namespace."""
    digest = F.sha1(F.concat(F.unhex(F.lit(URL_NAMESPACE)), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(digest, 17, 1), 16, 10).cast("int").bitwiseAND(3) + 8))
    return F.concat(
        F.substring(digest, 1, 8), F.lit("-"), F.substring(digest, 9, 4), F.lit("-5"), F.substring(digest, 14, 3), F.lit("-"),
        variant, F.substring(digest, 18, 3), F.lit("-"), F.substring(digest, 21, 12),
    )


def store_key(kind: str, c: Column) -> Column:
    return uuid5(F.concat(F.lit(f"chp-{kind}:"), text(c)))


def excerpt(c: Column) -> Column:
    """The whole text if short; else cut, back to the last full stop if that is far enough, or with dots."""
    whole = strip(text(c))
    cut = F.substring(whole, 1, EXCERPT_CHARS)
    at = F.greatest(*(F.when(F.instr(F.reverse(cut), s) > 0, F.length(cut) - F.instr(F.reverse(cut), s)).otherwise(-1) for s in (".", ";", "।")))
    ended = strip(F.substr(cut, F.lit(1), at + 1))
    return F.when(F.length(whole) <= EXCERPT_CHARS, whole).when(at >= EXCERPT_STOP, ended).otherwise(F.concat(F.regexp_replace(cut, f"{WS}+$", ""), F.lit("...")))


def citation(title: Column, concept: Column) -> Column:
    blank = lambda c, other: F.when(text(c) == "", other).otherwise(text(c))
    return F.concat(F.lit("["), blank(title, "Untitled"), F.lit(", concept: "), blank(concept, "unknown-concept"), F.lit("]"))


def language_signal(c: Column) -> Column:
    return F.when(text(c).rlike(r"[\u0900-\u097F]"), "hi-en").otherwise("en")


def generic_penalty(c: Column, cfg: Config) -> Column:
    """A quarter for every listed phrase in the lowered text, at most 0.6."""
    lowered = F.lower(text(c))
    total = F.lit(0.0)
    for p in cfg.generic_phrases:
        total = total + F.when(F.contains(lowered, F.lit(p)), 0.25).otherwise(0.0)
    return F.least(F.lit(0.6), total)


def item_text(title: Column, content: Column, description: Column) -> Column:
    return F.concat_ws(" ", text(title), text(content), text(description))


def fingerprint(c: Column) -> Column:
    """The first 80 terms of the text, joined by blanks."""
    return F.array_join(F.slice(terms(c), 1, 80), " ")


def split_list(c: Column) -> Column:
    return F.filter(F.transform(F.split(text(c), ","), clean_text), lambda p: p != "")


def evidence_text(cells: list[tuple[str, Column]], cleaned: bool = False) -> Column:
    """``key: value`` of the filled cells, joined by bars, the first 1000 characters; ``cleaned``: keys and values are clean text already."""
    parts = [F.when(text(v) != "", F.concat(F.lit(f"{k}: "), text(v))) for k, v in cells]
    whole = F.concat_ws(" | ", *parts)
    return F.substring(whole if cleaned else clean_text(whole), 1, 1000)


def parse_model_json(c: Column, schema: T.DataType | str) -> Column:
    """A JSON object from model output, fences and a leading json tag taken off; null where it is none."""
    whole = strip(text(c))
    bare = F.trim(whole, F.lit("`"))
    bare = F.when(F.lower(bare).startswith("json"), strip(F.substr(bare, F.lit(5)))).otherwise(bare)
    whole = F.when(whole.startswith("```"), bare).otherwise(whole)
    return F.when(strip(whole).startswith("{"), F.from_json(whole, schema, {"mode": "PERMISSIVE"}))


def asset_url(image_id: Column) -> Column:
    return F.concat(F.lit("/images/"), image_id, F.lit(".svg"))


def with_asset_urls(images: Column) -> Column:
    """Every entry of an image array with its ``asset_url``."""
    return F.transform(images, lambda x: x.withField("asset_url", asset_url(x["image_id"])))
