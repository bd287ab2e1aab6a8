"""URL filters: host and path rules, then a blocked Bloom filter before an exact hash join."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playmetry.llm.common import join_hot

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words of a block and odd factors that pick one bit in each of them.
FACTORS = (0x47B6137B, 0x44974D91, 0x8824AD5B, 0xA2B7289D, 0x705495C7, 0x2DF1424B, 0x9EFC4947, 0x5C6BFB31)
#: Blocks of the largest filter: 2**17 blocks of 9 longs are under 10 MB.
MOST_BLOCKS = 1 << 17


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased. Path: then up to `?`, `#` or the end.

    Both are empty for a null url and one without `://`.
    """
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def canonical(host: Column, path: Column) -> Column:
    """Host without a leading www., m. or blog., path without a last `/` or `.html`; no scheme, query or fragment."""
    return F.concat(F.regexp_replace(host, r"^(www|m|blog)\.", ""), F.regexp_replace(path, r"(\.html|/)$", ""))


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest fitting (verdict, host, path) rule as text, and its verdict; nulls if none fits.

    A rule fits its host and all subdomains where the path starts with the rule's. Of rules
    of one length the one that sorts first by code point wins. `rules` is a short list.
    """
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for told, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]), reverse=True):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        text = F.when(fits, F.lit(h + p)).otherwise(text)
        verdict = F.when(fits, F.lit(told)).otherwise(verdict)
    return text, verdict


def _bits(name: str) -> list[Column]:
    """One bit for each word of a block, from the upper half of a key's hash."""
    high = F.shiftrightunsigned(F.xxhash64(F.lit(7), F.col(name)), 33)
    one = F.lit(1).cast("long")
    places = [F.shiftright((high * F.lit(f)).bitwiseAND(F.lit(0xFFFFFFFF)), 26).cast("int") for f in FACTORS]
    return [F.call_function("shiftleft", one, p) for p in places]


def bloom_blocks(listed: DataFrame, name: str, blocks: int) -> DataFrame:
    """The filter as rows (block, w0 .. w7): at most `blocks` of them, however long the list is."""
    bits = listed.select(F.pmod(F.xxhash64(name), F.lit(blocks)).alias("block"), *[b.alias(f"w{i}") for i, b in enumerate(_bits(name))])
    return bits.groupBy("block").agg(*[F.expr(f"bit_or(w{i})").alias(f"w{i}") for i in range(len(FACTORS))])


def is_listed(rows: DataFrame, name: str, listed: DataFrame, out: str = "listed", bits_per_key: int = 16) -> DataFrame:
    """All rows and `out`: is column `name` among the keys of `listed` (one column of that name)?

    Rows whose block of the Bloom filter lacks a bit are not listed and stay where they are.
    The others, true hits and a few false ones, meet the list in an exact hash join. The
    filter has `bits_per_key` bits for every key, up to MOST_BLOCKS blocks, and is the only
    thing broadcast; a longer list only lets more rows through to the join. A null key is not
    listed, an empty list lists nothing, and repeated keys in the list count once.
    """
    keys = listed.select(name).where(F.col(name).isNotNull()).distinct()
    count = keys.count()
    blocks = 64
    while blocks < MOST_BLOCKS and blocks * 512 < count * bits_per_key:
        blocks *= 2
    table = bloom_blocks(keys, name, blocks)
    bits = [f"__b{i}" for i in range(len(FACTORS))]
    probed = rows.withColumn("__block", F.pmod(F.xxhash64(name), F.lit(blocks))).withColumns(dict(zip(bits, _bits(name))))
    probed = probed.join(F.broadcast(table.withColumnRenamed("block", "__block")), "__block", "left")
    holds = reduce(lambda a, b: a & b, [F.col(f"w{i}").bitwiseAND(F.col(b)) != 0 for i, b in enumerate(bits)])
    probed = probed.withColumn("__maybe", F.coalesce(holds, F.lit(False)) & F.col(name).isNotNull()).select(*rows.columns, "__maybe")
    clear = probed.where(~F.col("__maybe")).select(*rows.columns, F.lit(False).alias(out))
    hits = join_hot(probed.where("__maybe").select(*rows.columns), keys.withColumn("__exact", F.lit(True)).hint("shuffle_hash"), [name], "left")
    return clear.unionByName(hits.select(*rows.columns, F.coalesce("__exact", F.lit(False)).alias(out)))


def filter_urls(pages: DataFrame, listed: DataFrame, rules: Sequence[tuple[str, str, str]], key: str = "page_id", url: str = "url") -> DataFrame:
    """Per row: key, host, path, rule, listed, verdict (the rule's; without one, block if the canonical URL is listed).

    `listed` has one column, `canonical`. Null urls and urls without `://` have empty parts,
    fit a rule only if it asks for nothing, and are allowed. Repeated rows get equal results.
    """
    host, path = host_and_path(F.col(url))
    rows = pages.select(F.col(key).alias(key), host.alias("host"), path.alias("path")).withColumn("canonical", canonical(F.col("host"), F.col("path")))
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    judged = is_listed(rows, "canonical", listed)
    return judged.select(
        key, "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"), "listed"
    )


def listed_by_label(pages: DataFrame, labels: Sequence[str], url: str = "url") -> DataFrame:
    """Canonical URLs of all pages one of whose host labels is in `labels`: a block list drawn from the pages."""
    host, path = host_and_path(F.col(url))
    named = F.arrays_overlap(F.split(host, r"\."), F.array(*[F.lit(x) for x in labels]))
    return pages.where(named).select(canonical(host, path).alias("canonical")).distinct()
