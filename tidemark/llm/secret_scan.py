"""Secrets and who owns them, in native column expressions only.

Base kinds are found by patterns. Beyond them, every long mixed run of letters and digits is a candidate. Candidates are hashed and counted over the
corpus by distinct repository and owner: a value that many owners share is a copied example, one that stays with a single owner looks live.
Owner-specific candidates are added as spans of kind ``owned``; values of base spans are judged in the same way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut
from .text import LAST, row_keys, text_or_empty, untag

# Kinds in the order of the output, their patterns, and the least length of the whole match (of group 2 for assign).
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
# A run that fails the length rule takes no room from another match of these kinds, so the length can stand in the pattern.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
# Of these runs, those with a letter and a digit are candidates.
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}"
KINDS = ("assign", "access", "hex", "owned")
# A value is widely copied if several owners hold it, or if it stands in over SHARE of one owner's repositories (of at least COMMON, so that a few prove nothing).
MAX_OWNERS, COMMON, SHARE = 1, 20, 0.5
_BLOCK = 256


def _bind(value: Column, use) -> Column:
    """``use(value)``, with the value computed once."""
    return F.transform(F.array(value), use)[0]


def _running(numbers: Column, add) -> Column:
    """Running results of ``add`` (associative, over integers, from 0) along an array.

    Appending to one array would copy it for every element, so blocks of about the root of the length are scanned first, then their last values.
    """

    def scan_(xs: Column) -> Column:
        def step(acc, x):
            at = add(acc["at"], x)
            return F.struct(at.alias("at"), F.concat(acc["all"], F.array(at)).alias("all"))

        return F.aggregate(xs, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all")), step, lambda acc: acc["all"])

    def whole(xs: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(xs))).cast("int")
        parts = F.transform(F.sequence(F.lit(0), F.size(xs) - 1, width), lambda at: scan_(F.slice(xs, at + 1, width)))
        return _bind(parts, lambda ps: _bind(scan_(F.transform(ps, lambda p: F.element_at(p, -1))), lambda ends: F.flatten(
            F.transform(ps, lambda p, i: F.transform(p, lambda v: F.when(i > 0, add(F.get(ends, i - 1), v)).otherwise(v))))))

    return _bind(numbers, lambda xs: F.when(F.size(xs) > 0, whole(xs)).otherwise(F.array().cast("array<int>")))


def located(text: Column, pattern: str) -> Column:
    """Matches of a pattern as array<struct<start, end, value>> in code points.

    The pieces between the matches have the lengths that the matches lack. The text is split and searched only if it has a match.
    """
    both = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("matches"), F.split(text, pattern, -1).alias("pieces"))

    def place(b: Column) -> Column:
        ends = _running(F.zip_with(F.slice(b["pieces"], 1, F.size(b["matches"])), b["matches"], lambda p, m: F.length(p) + F.length(m)), lambda x, y: x + y)
        return F.zip_with(ends, b["matches"], lambda e, m: F.struct((e - F.length(m)).alias("start"), e.alias("end"), m.alias("value")))

    return F.when(text.rlike(pattern), _bind(both, place)).otherwise(F.array().cast("array<struct<start:int,end:int,value:string>>"))


def _value(match: Column) -> Column:
    return F.regexp_extract(match, ASSIGN, 2)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repository_col: str | None = None, rows_too: bool = False) -> DataFrame:
    """Secrets of every text: ``id_col, owner, secrets``, the latter an array of ``start, kind, end, value, owners, repositories, live``.

    ``kind`` counts from 0 in the order of ``KINDS``; positions are code points, the end is exclusive. A span is the whole match; ``value`` is the secret in it.
    ``owners`` and ``repositories`` are the distinct ones that hold the value (a repository is a distinct text of an owner unless ``repository_col`` names one, so
    exact copies count once; a null owner is an owner of its own). ``live`` means at most ``MAX_OWNERS`` owners, and not ``COMMON`` or more repositories that are
    over ``SHARE`` of its owner's: a share does not change with the size of the corpus. Candidates that are live and lie outside all base spans are added as kind 3.
    The work in a text grows nearly with its matches, not with their square. Null text is empty; tied and null ids stay apart, as rows are keyed by id
    and content; equal rows get equal results; other columns are ignored; no rows give no rows. ``rows_too`` adds ``row_key`` (``row_keys`` of
    id and text) for joins where ids may be tied or null; rows that share it have the same base spans, but may differ in what their owners add.
    """
    base = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("id"), text_or_empty(text_col).alias("text"),
        F.xxhash64(F.col(owner_col).isNull(), F.col(owner_col).cast("string")).alias("owner"),
        (F.xxhash64(text_or_empty(text_col)) if repository_col is None else F.xxhash64(F.col(repository_col).cast("string"))).alias("repository"),
    )
    kinds = [
        F.filter(located(F.col("text"), ASSIGN), lambda m: F.length(_value(m["value"])) >= 6),
        located(F.col("text"), ACCESS), located(F.col("text"), HEX),
        F.filter(located(F.col("text"), CANDIDATE), lambda m: m["value"].rlike("[0-9]") & m["value"].rlike("[A-Za-z]")),
    ]
    def of_kind(i: int, found: Column) -> Column:
        return F.transform(found, lambda m: F.struct(
            m["start"].alias("start"), F.lit(i).alias("kind"), m["end"].alias("end"), (_value(m["value"]) if i == 0 else m["value"]).alias("value")))

    spans = F.concat(*[of_kind(i, k) for i, k in enumerate(kinds)])
    rows = cut(base.select("id", "owner", "repository", row_keys("id", "text").alias("row_key"), F.xxhash64("id", "text", "owner", "repository").alias("rid"), F.array_sort(spans).alias("spans")))
    each = rows.filter(F.size("spans") > 0).select("id", "rid", "owner", "repository", F.explode("spans").alias("s")).select("*", F.sha2(F.col("s.value"), 256).alias("hash"))
    # First distinct places, then owners, then values: every step combines before its shuffle, so a value copied everywhere stays small.
    held = each.select("hash", "owner", "repository").distinct().groupBy("hash", "owner").agg(F.count("*").alias("n"))
    held = held.groupBy("hash").agg(F.count("*").alias("owners"), F.sum("n").alias("repositories"), F.min("owner").alias("owner"))
    sizes = rows.select("owner", "repository").distinct().groupBy("owner").agg(F.count("*").alias("all"))
    live = (F.col("owners") <= MAX_OWNERS) & ((F.col("repositories") < COMMON) | (F.col("repositories") <= SHARE * F.col("all")))
    held = held.join(sizes, "owner").select("hash", "owners", "repositories", live.alias("live"))
    judged = each.select("id", "rid", "s", "hash").distinct().join(held, "hash").select("id", "rid", F.struct("s.start", "s.kind", "s.end", "s.value", "owners", "repositories", "live").alias("s"))
    # A candidate overlaps a base span if some base span that starts before its end ends after its start.
    is_base = F.col("s.kind") < 3
    order = Window.partitionBy("id", "rid").orderBy(F.when(is_base, F.col("s.start")).otherwise(F.col("s.end") - 1), ~is_base).rowsBetween(Window.unboundedPreceding, 0)
    judged = judged.withColumn("reach", F.max(F.when(is_base, F.col("s.end"))).over(order))
    judged = judged.filter(is_base | (F.col("s.live") & (F.coalesce("reach", F.lit(0)) <= F.col("s.start"))))
    found = judged.groupBy("id", "rid").agg(F.array_sort(F.collect_list("s")).alias("secrets"))
    out = rows.select("id", "owner", "row_key", "rid").join(found, ["id", "rid"], "left")
    none = F.array().cast(out.schema["secrets"].dataType)
    return out.select(untag("id").alias(id_col), "owner", F.coalesce("secrets", none).alias("secrets"), *(["row_key"] if rows_too else []))


def printed(secrets: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(secrets, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(text: Column, secrets: Column, mark: str = "[REDACTED]") -> Column:
    """The text with every span (sorted by start) replaced by a mark; spans that overlap share one.

    A gap is cut from the blocks of text that it touches, as a substring of the whole text would be sought from its begin each time.
    """
    # Without DOTALL a block would end at a line break.
    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_BLOCK}}}"), F.lit(0))

    def between(parts: Column, start: Column, end: Column) -> Column:
        first = F.floor(start / _BLOCK).cast("int")
        count = F.floor((end - 1) / _BLOCK).cast("int") - first + 1
        return F.when(end > start, F.substring(F.array_join(F.slice(parts, first + 1, count), ""), start - first * _BLOCK + 1, end - start)).otherwise("")

    def join(b: Column) -> Column:
        def pieces(reach: Column) -> Column:
            def piece(s, i):
                before = F.when(i > 0, F.get(reach, i - 1)).otherwise(F.lit(0))
                return F.when(s["start"] >= before, F.concat(between(b["parts"], before, s["start"]), F.lit(mark))).otherwise("")

            return F.concat(F.array_join(F.transform(b["found"], piece), ""), between(b["parts"], F.element_at(reach, -1), F.length(text)))

        return _bind(_running(F.transform(b["found"], lambda s: s["end"]), F.greatest), pieces)

    return F.when(F.size(secrets) == 0, text).otherwise(_bind(F.struct(blocks.alias("parts"), secrets.alias("found")), join))
