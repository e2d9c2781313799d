"""URL filters as a temporal join of captures with dated list entries. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Days of a bucket of the as-of join.
BUCKET_DAYS = 32
HOST = "^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)"


def host_of(url):
    return F.regexp_extract(F.lower(F.coalesce(url, F.lit(""))), HOST, 1)


def suffixes(host):
    """A host and the domains above it, of two labels at least; a host of one label alone."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    return F.when(n < 2, F.array(host)).otherwise(F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.array_join(F.slice(labels, i, n), ".")))


def intervals(entries: DataFrame) -> DataFrame:
    """pattern, action, listed_day, until_day: an entry holds until the pattern's next entry.

    Of entries of one pattern and day the last action by name holds; `remove` ends what held and gives no interval.
    """
    one = entries.where("pattern is not null and listed_day is not null and action is not null").groupBy("pattern", "listed_day").agg(F.max("action").alias("action"))
    nxt = F.lead("listed_day").over(Window.partitionBy("pattern").orderBy("listed_day"))
    return one.select("pattern", "action", "listed_day", nxt.alias("until_day")).where("action <> 'remove'")


def temporal_verdicts(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", day_col: str = "fetched_day") -> DataFrame:
    """id, host, day, verdict, pattern, listed_day of every capture.

    A capture is judged by the entries (pattern, listed_day, action) that are active on its day: of those
    for its host and for domains above it, the longest pattern decides. Without one the verdict is
    `unlisted`, with null pattern and listed_day.

    Intervals are first joined to the distinct hosts and cut into buckets of days; a capture meets one
    row, that of its host and bucket, and picks among the few entries in it. So a host with a third of
    all captures only makes an equi-join uneven, which adaptive execution splits.

    A null or malformed URL has the host '' and a null day meets no entry: both are `unlisted`. Repeated
    rows are judged each; an empty table gives no rows.
    """
    c = captures.select(F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"), F.col(day_col).cast("int").alias("day")).withColumn("bucket", F.floor(F.col("day") / BUCKET_DAYS).cast("int"))
    seen = c.where("host <> '' and bucket is not null").groupBy("host").agg(F.min("bucket").alias("lo"), F.max("bucket").alias("hi"))
    wanted = seen.select("host", "lo", "hi", F.explode(suffixes(F.col("host"))).alias("pattern"))
    span = F.sequence(F.greatest("lo", F.floor(F.col("listed_day") / BUCKET_DAYS).cast("int")), F.least("hi", F.coalesce(F.floor((F.col("until_day") - 1) / BUCKET_DAYS).cast("int"), F.col("hi"))))
    meets = (F.floor(F.col("listed_day") / BUCKET_DAYS) <= F.col("hi")) & (F.coalesce(F.floor((F.col("until_day") - 1) / BUCKET_DAYS), F.col("hi")) >= F.col("lo"))
    held = wanted.join(intervals(entries), "pattern").where(meets).withColumn("bucket", F.explode(span))
    active = F.struct(F.length("pattern").alias("len"), "pattern", "action", "listed_day", "until_day")
    timeline = held.groupBy("host", "bucket").agg(F.collect_list(active).alias("entries"))  # a few entries a day of one bucket
    now = F.filter("entries", lambda e: (e["listed_day"] <= F.col("day")) & (e["until_day"].isNull() | (F.col("day") < e["until_day"])))
    out = c.join(timeline, ["host", "bucket"], "left").withColumn("rule", F.array_max(now))
    return out.select(F.col("id").alias(id_col), "host", F.col("day").alias(day_col), F.coalesce("rule.action", F.lit("unlisted")).alias("verdict"), "rule.pattern", "rule.listed_day")


def _number(text, salt: str):
    return F.conv(F.substring(F.md5(F.concat(text, F.lit(salt))), 1, 7), 16, 10).cast("long")


def dated_captures(pages: DataFrame) -> DataFrame:
    """The pages with a fetch day of 2024 that follows from page_id: the table has no dates."""
    return pages.select("page_id", "url", (19723 + _number(F.col("page_id").cast("string"), "@") % 366).cast("int").alias("fetched_day"))


def dated_entries(pages: DataFrame) -> DataFrame:
    """List entries that follow from the pages' hosts and domains: three dated changes for about half of them."""
    pattern = pages.select(F.explode(suffixes(host_of(F.col("url")))).alias("pattern")).where("pattern <> ''").distinct().where(_number(F.col("pattern"), "") % 2 == 0)
    k = pattern.select("pattern", F.explode(F.array(F.lit("1"), F.lit("2"), F.lit("3"))).alias("k"))
    mixed = F.concat(F.col("pattern"), F.lit("#"), F.col("k"))
    action = F.element_at(F.array(F.lit("block"), F.lit("allow"), F.lit("remove"), F.lit("block")), (_number(mixed, "a") % 4 + 1).cast("int"))
    return k.select("pattern", (19693 + _number(mixed, "d") % 396).cast("int").alias("listed_day"), action.alias("action"))


SQL = r"""
WITH c AS (
  SELECT page_id, regexp_extract(lower(coalesce(url, '')), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)', 1) AS host,
    (19723 + ('0x' || substr(md5(page_id::VARCHAR || '@'), 1, 7))::BIGINT % 366)::INTEGER AS fetched_day
  FROM pages
), h AS (SELECT DISTINCT host, string_split(host, '.') AS l FROM c WHERE host <> ''
), s AS (
  SELECT host, unnest(CASE WHEN len(l) < 2 THEN [host] ELSE list_transform(range(1, len(l)), lambda i: array_to_string(l[i:], '.')) END) AS pattern FROM h
), p AS (SELECT DISTINCT pattern FROM s WHERE ('0x' || substr(md5(pattern), 1, 7))::BIGINT % 2 = 0
), e AS (
  SELECT pattern, (19693 + ('0x' || substr(md5(pattern || '#' || k || 'd'), 1, 7))::BIGINT % 396)::INTEGER AS listed_day,
    (['block', 'allow', 'remove', 'block'])[('0x' || substr(md5(pattern || '#' || k || 'a'), 1, 7))::BIGINT % 4 + 1] AS action
  FROM p, (VALUES ('1'), ('2'), ('3')) v(k)
), one AS (SELECT pattern, listed_day, max(action) AS action FROM e GROUP BY ALL
), held AS (
  SELECT *, lead(listed_day) OVER (PARTITION BY pattern ORDER BY listed_day) AS until_day FROM one
), matched AS (
  SELECT page_id, c.host, fetched_day, held.*, row_number() OVER (PARTITION BY page_id ORDER BY length(held.pattern) DESC) AS r
  FROM c JOIN s ON c.host = s.host JOIN held ON held.pattern = s.pattern AND listed_day <= fetched_day AND (until_day IS NULL OR fetched_day < until_day)
  WHERE action <> 'remove')
SELECT c.page_id, c.host, c.fetched_day, coalesce(m.action, 'unlisted') AS verdict, m.pattern, m.listed_day
FROM c LEFT JOIN (SELECT * FROM matched WHERE r = 1) m ON c.page_id = m.page_id
"""
