"""The record store and the work queue as tables: keyed merges by union and aggregation, one shuffle by key each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions.dates import iso_time
from gleaner.sources.shared import numbered

QUEUE = """dedup_key string, source_site string, url string, listing_url string, hint_title string, state string, attempts int,
last_error string, discovered_at string, updated_at string"""
RUNS = "id bigint, kind string, source_site string, started_at string, finished_at string, ok boolean, stats string, error string"
TAG, STORY_TAG = "id bigint, name string, kind string", "story_id bigint, tag_id bigint"
#: A story by type of column; a mark says that NULL is refused.
STORY_COLUMNS = {
    "bigint": "id!",
    "string": """dedup_key! source_url! source_site! source_site_name! body_text! body_with_attribution! attribution_block! content_hash! license_note!
first_seen_at! updated_at! fetched_at! extra! title author_url author_name external_id canonical_url language published_at_raw published_at
seo_slug target_funnel primary_niche recommended_affiliate source_description adapter_version""",
    "array<string>": "flags! categories! tags! source_keywords! detected_commercial_links! detected_ad_placements!",
    "int": "revision! char_count! word_count! paragraph_count! published_year http_status",
    "boolean": "is_complete!",
}
STORIES = ", ".join(f"{c.rstrip('!')} {t}" for t, names in STORY_COLUMNS.items() for c in names.split())
REQUIRED = [c[:-1] for names in STORY_COLUMNS.values() for c in names.split() if c.endswith("!")]
UNIQUE = ("id", "dedup_key", "source_url")
TABLES = {"stories": STORIES, "tag": TAG, "story_tag": STORY_TAG, "queue": QUEUE, "runs": RUNS}
JSON_LISTS = "tags categories flags source_keywords detected_ad_placements detected_commercial_links".split()
STATE = ("id", "first_seen_at", "updated_at", "revision")


def merged(stories: DataFrame, batch: DataFrame, order: str, as_of: Column) -> DataFrame:
    """Upsert by dedup_key. `order` is a column of `batch` with the order of arrival, and breaks no ties but its own.

    Existing rows keep id and first_seen_at; the last write gives all other columns, NULLs included; revision grows by the
    number of writes. Columns beside those of `stories`: outcome ("inserted" for the only write of a new key, else
    "unchanged", NULL where nothing was written) and content_changed. New keys have a NULL id: see `with_ids`.
    """
    payload = [c for c in stories.columns if c not in (*STATE, "dedup_key")]
    now = iso_time(as_of)
    old = stories.select("dedup_key", F.lit(-1).cast("bigint").alias("_order"), F.struct(*payload).alias("_row"), *STATE)
    new = batch.select("dedup_key", F.col(order).cast("bigint").alias("_order"), F.struct(*payload).alias("_row"), F.lit(None).cast("bigint").alias("id"), now.alias("first_seen_at"), now.alias("updated_at"), F.lit(1).alias("revision"))
    g = old.unionByName(new).groupBy("dedup_key").agg(
        F.max_by("_row", F.struct("_order", F.hash("_row"))).alias("_row"),
        F.min("id").alias("id"),
        F.min_by("first_seen_at", "_order").alias("first_seen_at"),
        F.max_by("updated_at", "_order").alias("updated_at"),
        F.sum("revision").cast("int").alias("revision"),
        F.max("_order").alias("_last"),
        *([F.min_by(F.col("_row.content_hash"), "_order").alias("_hash")] if "content_hash" in payload else []),
    )
    g = g.withColumn("outcome", F.when(F.col("_last") >= 0, F.when(F.col("revision") == 1, F.lit("inserted")).otherwise("unchanged")))
    changed = ~F.col("_hash").eqNullSafe(F.col("_row.content_hash")) if "content_hash" in payload else F.lit(None).cast("boolean")
    return g.select("dedup_key", "_row.*", *STATE, "outcome", changed.alias("content_changed"))


def with_ids(merged_rows: DataFrame) -> DataFrame:
    """Ids after the greatest one for rows without, in order of first_seen_at and key."""
    top = merged_rows.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top"))
    fresh = merged_rows.where(F.col("id").isNull()).drop("id").crossJoin(F.broadcast(top))
    fresh = numbered(fresh, "id", [F.col("first_seen_at"), F.col("dedup_key")], F.col("_top")).drop("_top")
    return merged_rows.where(F.col("id").isNotNull()).unionByName(fresh)


def source_url_clashes(stories: DataFrame) -> DataFrame:
    """Rows whose source_url another key has too: what the store must refuse."""
    bad = stories.where(F.col("source_url").isNotNull()).groupBy("source_url").agg(F.count("*").alias("_n")).where("_n > 1")
    return stories.join(bad.select("source_url"), "source_url", "left_semi")


def exists(keys: DataFrame, stories: DataFrame) -> DataFrame:
    return keys.join(stories.select("dedup_key"), "dedup_key", "left_semi")


def enqueue(queue: DataFrame, found: DataFrame, as_of: Column, order: list[str] | None = None) -> DataFrame:
    """The queue with the new keys of `found` (source_site, url, dedup_key, listing_url, hint_title) as pending.

    Known keys are left as they are. Of equal keys in `found` the first by `order` counts.
    """
    rank = F.struct(*(order or ["url"]), F.xxhash64("source_site", "url", "listing_url", "hint_title"))
    row = F.struct("source_site", "url", "listing_url", "hint_title")
    first = found.groupBy("dedup_key").agg(F.min_by(row, rank).alias("_r")).select("dedup_key", "_r.*")
    now = iso_time(as_of)
    fresh = first.join(queue.select("dedup_key"), "dedup_key", "left_anti").withColumns(
        {"state": F.lit("pending"), "attempts": F.lit(0), "last_error": F.lit(None).cast("string"), "discovered_at": now, "updated_at": now}
    )
    return queue.unionByName(fresh.select(*queue.columns))


def mark(queue: DataFrame, updates: DataFrame, as_of: Column, order: str | None = None) -> DataFrame:
    """State and error of `updates` (dedup_key, state, error, bump) put on the queue; a NULL error overwrites too.

    Several updates of a key apply in `order`: the last one's state stays, each bump counts. Unknown keys are ignored.
    """
    u = updates.withColumn("_o", F.col(order) if order else F.lit(0)).groupBy("dedup_key").agg(
        F.max_by(F.struct("state", "error"), F.struct("_o", F.hash("state", "error"))).alias("_u"), F.count_if("bump").cast("int").alias("_bumps")
    )
    hit = F.col("_u").isNotNull()
    return queue.join(u, "dedup_key", "left").select(
        *(
            {
                "state": F.when(hit, F.col("_u.state")).otherwise(F.col("state")).alias("state"),
                "last_error": F.when(hit, F.col("_u.error")).otherwise(F.col("last_error")).alias("last_error"),
                "updated_at": F.when(hit, iso_time(as_of)).otherwise(F.col("updated_at")).alias("updated_at"),
                "attempts": (F.col("attempts") + F.coalesce("_bumps", F.lit(0))).alias("attempts"),
            }.get(c, F.col(c))
            for c in queue.columns
        )
    )


def pending(queue: DataFrame, site: str | None = None, limit: int | None = None, max_attempts: int = 3, include_failed: bool = False) -> DataFrame:
    """Work to do, oldest first; no limit for None or 0. Ties go by key."""
    q = queue.where(F.col("state").isin(*(["pending", "failed"] if include_failed else ["pending"])) & (F.col("attempts") < max_attempts))
    q = q.where(F.col("source_site") == site) if site else q
    q = q.orderBy("discovered_at", "dedup_key")
    return q.limit(limit) if limit else q


def scan(stories: DataFrame, niche: str | None = None, site: str | None = None, limit: int | None = None) -> DataFrame:
    """Stories by id, with lists decoded where they are JSON texts (broken ones are empty)."""
    s = stories.where(F.col("source_site") == site) if site else stories
    s = s.where(F.col("primary_niche") == niche) if niche else s
    s = s.orderBy("id")
    s = s.limit(limit) if limit else s
    texts = {c for c, t in s.dtypes if t == "string"} & set(JSON_LISTS)
    empty = F.array().cast("array<string>")
    return s.withColumns({c: F.when(F.col(c).isNotNull(), F.coalesce(F.from_json(c, "array<string>"), empty)) for c in texts})


def to_json_lists(stories: DataFrame) -> DataFrame:
    return stories.withColumns({c: F.to_json(c) for c, t in stories.dtypes if t == "array<string>"})


def tag_pairs(records: DataFrame) -> DataFrame:
    """(story_id, name, kind) of tags and categories, each once."""
    one = lambda c, kind: records.select(F.col("id").alias("story_id"), F.explode(c).alias("name"), F.lit(kind).alias("kind"))
    return one("tags", "tag").unionByName(one("categories", "category")).distinct()


def sync_tags(tag: DataFrame, story_tag: DataFrame, records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tag, story_tag) after the tags of `records` (id, tags, categories) replaced the old ones; unused tags stay."""
    pairs = tag_pairs(records)
    new = pairs.select("name", "kind").distinct().join(tag, ["name", "kind"], "left_anti")
    top = tag.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top"))
    new = numbered(new.crossJoin(F.broadcast(top)), "id", [F.col("kind"), F.col("name")], F.col("_top")).drop("_top")
    dim = tag.unionByName(new.select(*tag.columns))
    kept = story_tag.join(records.select(F.col("id").alias("story_id")), "story_id", "left_anti")
    fresh = pairs.join(dim, ["name", "kind"]).select("story_id", F.col("id").alias("tag_id"))
    return dim, kept.select("story_id", "tag_id").unionByName(fresh)


def start_runs(runs: DataFrame, started: DataFrame, as_of: Column) -> DataFrame:
    """Runs (kind, source_site) appended with the next ids, in order of kind and site."""
    top = runs.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top"))
    new = numbered(started.select("kind", "source_site").crossJoin(F.broadcast(top)), "id", [F.col("kind"), F.col("source_site")], F.col("_top"))
    new = new.select("id", "kind", "source_site", iso_time(as_of).alias("started_at"))
    return runs.unionByName(new, allowMissingColumns=True)


def finish_runs(runs: DataFrame, ends: DataFrame, as_of: Column) -> DataFrame:
    """The results (id, ok, stats, error) put on their runs."""
    e = ends.select("id", F.struct("ok", "stats", "error").alias("_e"))
    hit = F.col("_e").isNotNull()
    new = {"finished_at": iso_time(as_of), "ok": F.col("_e.ok"), "stats": F.col("_e.stats"), "error": F.col("_e.error")}
    return runs.join(e, "id", "left").select(*(F.when(hit, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in runs.columns))


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def open_store(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of a store in a folder; those it lacks are made, empty."""
    out = {}
    for name, schema in TABLES.items():
        at = f"{path.rstrip('/')}/{name}"
        empty(spark, schema).write.mode("ignore").parquet(at)
        out[name] = spark.read.schema(schema).parquet(at)
    return out


def as_stories(rows: DataFrame) -> DataFrame:
    """All columns of a story, with what stands for those `rows` lacks: NULL, empty lists and texts, no counts, first revision."""
    have = set(rows.columns)
    rest = {"license_note": F.lit(""), "extra": F.lit("{}"), "is_complete": F.lit(False), "revision": F.lit(1), **{c: F.lit(0) for c in ("paragraph_count", "word_count", "char_count")}}
    kinds = [(c.rstrip("!"), t) for t, names in STORY_COLUMNS.items() for c in names.split()]
    empty_list = F.array().cast("array<string>")
    value = lambda c, t: F.coalesce(F.col(c) if c in have else F.lit(None).cast(t), rest.get(c, empty_list if t == "array<string>" else F.lit(None).cast(t)))
    return rows.select(*(value(c, t).cast(t).alias(c) for c, t in kinds))


def violations(stories: DataFrame) -> DataFrame:
    """(problem, n): NULLs in columns that refuse them, and values of unique columns that several rows have. One row a column at most."""
    nulls = stories.agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in REQUIRED))
    nulls = nulls.select(F.explode(F.array(*(F.struct(F.lit(f"NULL {c}").alias("problem"), F.col(c).alias("n")) for c in REQUIRED))).alias("p")).select("p.*")
    for c in UNIQUE:
        twice = stories.where(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
        nulls = nulls.union(twice.agg(F.count(F.lit(1)).alias("n")).select(F.lit(f"repeated {c}"), "n"))
    return nulls.where("n > 0")


def write_stories(stories: DataFrame, path: str) -> None:
    """Writes stories into a folder of their own, unless rows break the rules: then nothing is written."""
    found = violations(stories).collect()
    if found:
        raise ValueError("; ".join(f"{r.problem}: {r.n}" for r in found))
    stories.write.parquet(path)
