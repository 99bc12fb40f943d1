"""Secret scans by corpus-wide ownership frequency, in DataFrame functions only.

Base matches (``assign``, ``access``, ``hex``) always stay. A generic candidate is a run of 20 or more key
characters that mixes upper case, lower case and digits and overlaps no base match. The hash of every
candidate value is counted over the whole corpus by distinct repositories and owners: a value that more than
``max_owners`` owners hold is a widely copied example, any other is taken for a live credential, however many
repositories of its owners hold it. Only repositories without an owner (null or empty) are counted themselves:
nobody knows how many owners they have, so a value in more than ``max_repos`` of them is an example too. Live
generic candidates are added to the spans as kind ``live``.

Defined results: null text is empty; a text without matches has zero counts, the hash of the empty string and
empty spans; repeated rows each get their own result and count once per repository; other columns of the input
are ignored; an empty table gives an empty result; offsets are code points of the whole text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sablevec.session import materialise

#: Fixed patterns of the base kinds; Java's (?i) folds ASCII letters only.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A shorter run fails as a whole and holds no other match, so the least length may stand in the pattern itself.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
GENERIC = r"[A-Za-z0-9+/_-]{20,}"
KINDS = ("assign", "access", "hex", "live")

NONE = "cast(array() as array<struct<kind:string,s:int,e:int,value:string,r:int>>)"


def _q(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _found(kind: int, pattern: str, value: int, keep: str, seek: str = "") -> str:
    """SQL for the kept matches of one kind; gaps between matches and the matches themselves add up to offsets."""
    rx = _q(pattern)
    made = f"""aggregate(
        zip_with(zip_with(regexp_extract_all(t, {rx}, 0), regexp_extract_all(t, {rx}, {value}), (m, v) -> struct(m as m, v as v)),
                 slice(split(t, {rx}, -1), 1, size(regexp_extract_all(t, {rx}, 0))), (p, g) -> struct(length(g) as g, p.m as m, p.v as v)),
        struct(0 as pos, {NONE} as found),
        (a, x) -> struct(a.pos + x.g + length(x.m) as pos,
            case when {keep} then concat(a.found, array(struct('{KINDS[kind]}' as kind, a.pos + x.g as s,
                a.pos + x.g + length(x.m) as e, x.v as value, {kind} as r))) else a.found end as found),
        a -> a.found)"""
    return f"case when t rlike {_q(seek or pattern)} then {made} else {NONE} end"


def candidates(docs: DataFrame, text: str = "text", owner: str | None = "source", repo: str | None = "doc_id", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``k0`` and so on for ``keep``, a row number, the owner, the repository, ``base`` and ``generic`` matches."""
    t = docs.select(
        *[F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(keep)],
        (F.col(f"`{owner}`").cast("string") if owner else F.lit(None).cast("string")).alias("owner"),
        (F.col(f"`{repo}`").cast("string") if repo else F.lit(None).cast("string")).alias("repo"),
        F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("t"),
    )
    base = f"""concat({_found(0, ASSIGN, 2, "length(x.v) >= 6", "(?i:password|passwd|secret|token|api_?key)")},
        {_found(1, ACCESS, 0, "true")}, {_found(2, HEX, 0, "true")})"""
    mixed = "x.v rlike '[0-9]' and x.v rlike '[A-Z]' and x.v rlike '[a-z]'"
    return (
        t.withColumn("base", F.expr(base))
        .withColumn("generic", F.expr(_found(3, GENERIC, 0, mixed)))
        .withColumn("generic", F.expr("filter(generic, g -> not exists(base, b -> b.s < g.e and g.s < b.e))"))
        .drop("t")
        .withColumn("rid", F.monotonically_increasing_id())
    )


def owned(c: DataFrame, max_owners: int, max_repos: int) -> DataFrame:
    """Every value of ``candidates`` by its hash ``vh``: how many owners and repositories hold it, and whether it is live."""
    each = c.where("size(base) > 0 or size(generic) > 0").select("owner", "repo", F.explode(F.concat("base", "generic")).alias("x")).withColumn("vh", F.sha2("x.value", 256))
    # distinct repositories of each owner first: a value that a third of all rows hold is reduced before it meets in one row
    pair = each.groupBy("vh", F.coalesce("owner", F.lit("")).alias("owner"), F.coalesce("repo", F.lit("")).alias("repo")).agg(F.lit(1).alias("one"))
    by_owner = pair.groupBy("vh", "owner").agg(F.count("*").alias("n"))
    by_value = by_owner.groupBy("vh").agg(F.count("*").alias("owners"), F.sum("n").alias("repos"), F.sum(F.when(F.col("owner") == "", F.col("n")).otherwise(0)).alias("unowned"))
    return by_value.select("vh", "owners", "repos", ((F.col("owners") <= max_owners) & (F.col("unowned") <= max_repos)).alias("live"))


def scan(docs: DataFrame, text: str = "text", owner: str | None = "source", repo: str | None = "doc_id", keys: tuple[str, ...] = ("doc_id",), max_owners: int = 2, max_repos: int = 20) -> DataFrame:
    """One row per row of ``docs``: ``keys``, and ``found`` (kind, s, e, value, r, owners, repos, live), sorted by start and kind."""
    c = materialise(candidates(docs, text, owner, repo, keys), "secrets")
    each = c.where("size(base) > 0 or size(generic) > 0").select("rid", F.explode(F.concat("base", "generic")).alias("x")).withColumn("vh", F.sha2("x.value", 256))
    found = (
        # values are a table of their own, so that rows of one value can be split
        each.join(materialise(owned(c, max_owners, max_repos), "owned"), "vh")
        .groupBy("rid")
        .agg(F.expr("array_sort(collect_list(struct(x.s as s, x.r as r, x.e as e, x.kind as kind, x.value as value, owners, repos, live)))").alias("found"))
    )
    out = c.join(found, "rid", "left")
    none = F.expr("cast(array() as array<struct<s:int,r:int,e:int,kind:string,value:string,owners:bigint,repos:bigint,live:boolean>>)")
    return out.select(*[F.col(f"k{i}").alias(k) for i, k in enumerate(keys)], F.coalesce("found", none).alias("found"))


def digest(found: DataFrame) -> DataFrame:
    """The result columns of ``scan``: counts, the hash of the base spans, and all spans."""
    spans = "array_join(transform(filter(found, x -> {0}), x -> concat_ws(':', x.kind, cast(x.s as string), cast(x.e as string))), ',')"
    n = "cast(size(filter(found, x -> x.kind = '{0}')) as bigint)"
    return found.select(
        "doc_id",
        *[F.expr(n.format(k)).alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(F.expr(spans.format("x.kind <> 'live'")), 256).alias("base_sha256"),
        F.expr(spans.format("x.kind <> 'live' or x.live")).alias("spans"),
        F.expr("cast(size(filter(found, x -> x.kind = 'live' and x.live)) as bigint)").alias("n_live"),
        F.expr("cast(size(filter(found, x -> not x.live)) as bigint)").alias("n_example"),
    )


def redact(docs: DataFrame, text: str = "text", mark: str = "[SECRET]", owner: str | None = "source", repo: str | None = "doc_id", max_owners: int = 2, max_repos: int = 20) -> DataFrame:
    """``docs`` with every base or live span replaced by ``mark``; ``n_chars``, if there, follows the new text.

    Base spans are blotted out where they are found. Only rows with generic candidates meet the counts of their values.
    """
    cols = docs.columns
    c = materialise(candidates(docs, text, owner, repo, tuple(cols)), "redact")
    asked = c.where("size(generic) > 0").select("rid", F.explode("generic").alias("x"))
    values = materialise(owned(c, max_owners, max_repos).where("live").select("vh"), "live")
    live = asked.withColumn("vh", F.sha2("x.value", 256)).join(values, "vh").groupBy("rid").agg(F.collect_list("x").alias("live"))
    none = F.expr(NONE)
    rows = c.where("size(generic) = 0").withColumn("live", none).unionByName(c.where("size(generic) > 0").join(live, "rid", "left").withColumn("live", F.coalesce("live", none)))
    rows = rows.withColumn("found", F.expr("array_sort(transform(concat(base, live), x -> struct(x.s as s, x.r as r, x.e as e)))"))
    t = f"k{cols.index(text)}"
    # spans are in order of their starts; an overlapped part is passed once
    hidden = f"""aggregate(found, struct(0 as pos, cast(array() as array<string>) as out),
        (a, x) -> struct(greatest(a.pos, x.e) as pos, case when x.s >= a.pos
            then concat(a.out, array(substring({t}, a.pos + 1, x.s - a.pos), {_q(mark)})) else a.out end as out),
        a -> concat(array_join(a.out, ''), substring({t}, a.pos + 1)))"""
    new = F.expr(f"case when size(found) = 0 then {t} else {hidden} end")
    made = {text: new}
    if "n_chars" in cols:
        made["n_chars"] = F.when(F.expr("size(found) = 0"), F.col(f"k{cols.index('n_chars')}")).otherwise(F.length(new).cast(docs.schema["n_chars"].dataType))
    return rows.select(*[made.get(k, F.col(f"k{i}")).alias(k) for i, k in enumerate(cols)])
