"""How the given tables stand for the model's tables, in Spark and, expression by expression, in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..functions.stem import STEP_2, STEP_3, STEP_4
from ..functions.text import ACCENTED, PLAIN
from ..model import TYPES
from ..operators import lexical, textindex
from ..session import scratch

#: The reference time of every query.
NOW_TEXT = "2024-02-15 00:00:00"


def now() -> Column:
    return F.lit(NOW_TEXT).cast("timestamp")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    order = ("memory", "session", "daily", "skill", "project", "distillation", "decision", "person")
    assert set(order) == set(TYPES)
    type_ = F.element_at(F.array(*[F.lit(t) for t in order]), (d % 8 + 1).cast("int"))
    created = now() - F.make_dt_interval((d * 37 % 200).cast("int"))
    return table(spark, sf_dir, "documents").select(
        d.alias("id"),
        type_.alias("type"),
        F.substring(F.split_part("text", F.lit("\n"), F.lit(1)), 1, 80).alias("title"),
        F.col("text").alias("body"),
        F.array("lang", "source").alias("tags"),
        F.col("source"),
        F.concat(F.lit("/root"), (d % 5).cast("string"), F.lit("/"), d.cast("string"), F.lit(".md")).alias("ref"),
        created.alias("created"),
        (created + F.make_dt_interval((d % 5).cast("int"))).alias("updated"),
        F.when(d % 3 != 0, (d % 11) / 10.0).alias("importance"),
        F.when(d % 29 == 0, now() - F.make_dt_interval(F.lit(1))).when(d % 31 == 0, now() + F.make_dt_interval(F.lit(30))).alias("valid_to"),
        F.when((d % 37 == 0) & (d > 0), d - 1).alias("deprecated_by"),
        F.when(d % 41 == 0, now()).alias("deleted_at"),
        F.concat(F.lit("memories/"), d.cast("string"), F.lit(".md")).alias("path"),
        F.col("lang"),
    )


RECORDS_SQL = f"""records AS (
  SELECT doc_id AS id, ['memory','session','daily','skill','project','distillation','decision','person'][(doc_id % 8 + 1)::INT] AS type,
    substr(split_part(text, chr(10), 1), 1, 80) AS title, text AS body, [lang, source] AS tags, source,
    '/root' || (doc_id % 5)::VARCHAR || '/' || doc_id::VARCHAR || '.md' AS ref,
    TIMESTAMP '{NOW_TEXT}' - to_days((doc_id * 37 % 200)::INT) AS created,
    TIMESTAMP '{NOW_TEXT}' - to_days((doc_id * 37 % 200)::INT) + to_days((doc_id % 5)::INT) AS updated,
    CASE WHEN doc_id % 3 <> 0 THEN (doc_id % 11)::DOUBLE / 10.0::DOUBLE END AS importance,
    CASE WHEN doc_id % 29 = 0 THEN TIMESTAMP '{NOW_TEXT}' - to_days(1) WHEN doc_id % 31 = 0 THEN TIMESTAMP '{NOW_TEXT}' + to_days(30) END AS valid_to,
    CASE WHEN doc_id % 37 = 0 AND doc_id > 0 THEN doc_id - 1 END AS deprecated_by,
    CASE WHEN doc_id % 41 = 0 THEN TIMESTAMP '{NOW_TEXT}' END AS deleted_at,
    'memories/' || doc_id::VARCHAR || '.md' AS path, lang
  FROM documents)"""


def words_sql(expression: str) -> str:
    return f"regexp_extract_all(translate(lower({expression}), '{ACCENTED}', '{PLAIN}'), '[\\p{{L}}\\p{{N}}]+')"


HASH_SQL = r"sha256(trim(regexp_replace(lower({}), '\s+', ' ', 'g')))"


_asked: dict[tuple[str, str], DataFrame] = {}


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated query set; found once per application where a shared folder can keep it."""
    if not (spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()):
        return mined_queries(spark, sf_dir)
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _asked:
        _asked[key] = mined_queries(spark, sf_dir).checkpoint()
    return _asked[key]


def mined_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, query, embedding): each benchmark item's two terms that most records have, of those fewer than half have."""
    rows = records(spark, sf_dir)
    items = table(spark, sf_dir, "benchmark").select("item_id", F.explode(F.array_distinct(text.tokens(F.col("text")))).alias("term"))
    df = lexical.frequencies(rows, items)
    n = rows.agg(F.count(F.lit(1)).alias("n"))
    chosen = items.join(df, "term").crossJoin(F.broadcast(n)).where(F.col("df") * 2 < F.col("n"))
    from pyspark.sql import Window

    best = chosen.withColumn("place", F.row_number().over(Window.partitionBy("item_id").orderBy(F.col("df").desc(), "term"))).where("place <= 2")
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("place", "term"))), lambda x: x["term"])
    asked = best.groupBy("item_id").agg(F.array_join(ordered, " ").alias("query"))
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_id"), "embedding")
    vectors = vectors.join(F.broadcast(items.select("item_id").distinct()), "item_id", "left_semi")
    return asked.join(vectors, "item_id", "left").withColumnRenamed("item_id", "query_id")


QUERIES_SQL = f"""toks AS (SELECT id, unnest({words_sql("concat_ws(' ', title, body, lang, source)")}) AS term FROM records),
tf AS (SELECT id, term, count(*) AS tf FROM toks GROUP BY id, term),
dl AS (SELECT id, count(*) AS dl FROM toks GROUP BY id),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
st AS (SELECT (SELECT count(*) FROM records) AS n, (SELECT sum(dl) FROM dl)::DOUBLE / (SELECT count(*) FROM records) AS avgdl),
items AS (SELECT DISTINCT item_id, unnest({words_sql("text")}) AS term FROM benchmark),
best AS (SELECT item_id, term, row_number() OVER (PARTITION BY item_id ORDER BY df DESC, term) AS place
  FROM items JOIN df USING (term), st WHERE df * 2 < n QUALIFY place <= 2),
queries AS (SELECT item_id AS query_id, string_agg(term, ' ' ORDER BY place) AS query FROM best GROUP BY item_id),
qt AS (SELECT item_id AS query_id, term, 1 AS times, count(*) OVER (PARTITION BY item_id) AS terms FROM best)"""

def bm25_sql(asked: str = "qt", tf: str = "tf", df: str = "df") -> str:
    return f"""bm AS (SELECT query_id, t.id,
    sum(-times * (CASE WHEN ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) <= 0 THEN 1e-6::DOUBLE ELSE ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) END)
      * (tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl)))) AS score, count(*) AS matched, any_value(terms) AS terms
  FROM {asked} JOIN {tf} t USING (term) JOIN {df} USING (term) JOIN dl ON dl.id = t.id, st GROUP BY query_id, t.id HAVING count(*) = any_value(terms))"""



def stored_index(spark: SparkSession, sf_dir: str) -> textindex.TextIndex:
    """The records in a stored index that went through changes: old bodies replaced, records added and deleted again."""
    rows = records(spark, sf_dir)
    index = textindex.TextIndex(spark, textindex.scratch_root(scratch(spark), "index"), id_type="bigint")
    stale = F.col("id") % 5 == 0
    index.upsert(rows.withColumn("body", F.when(stale, F.concat(F.lit("old words, outdated: "), F.substring("body", 1, 200))).otherwise(F.col("body"))))
    index.upsert(rows.where(stale))
    passing = rows.where("id % 11 = 3").withColumn("id", -F.col("id") - 1)
    index.upsert(passing)
    index.delete(passing.select("id"))
    return index


def _porter() -> list[str]:
    """Steps of the Porter stemmer as expressions over `w`, in order."""
    c, v = "[^aeiou]", "[aeiouy]"
    cc, vv = f"{c}[^aeiouy]*", f"{v}[aeiou]*"
    more = lambda x, n: f"regexp_matches({x}, '^({cc})?" + f"{vv}{cc}" * n + "')"  # noqa: E731  measure of n at least
    vowel = lambda x: f"regexp_matches({x}, '^({cc})?{v}')"
    short = lambda x: f"regexp_matches({x}, '^{cc}{v}[^aeiouwxy]$')"
    one = lambda x: f"regexp_matches({x}, '^({cc})?{vv}{cc}({vv})?$')"
    cut = lambda n, x="w": f"left({x}, length({x}) - {n})"

    def suffixes(rules: dict[str, str], n: int) -> str:
        longest = sorted(rules, key=len, reverse=True)
        whens = [f"WHEN ends_with(w, '{s}') THEN CASE WHEN {more(cut(len(s)), n)}{' AND right(' + cut(3) + ", 1) IN ('s', 't')" if s == 'ion' else ''} THEN {cut(len(s))} || '{rules[s]}' ELSE w END" for s in longest]
        return "CASE " + " ".join(whens) + " ELSE w END"

    tail = lambda x: (
        f"CASE WHEN regexp_matches({x}, '(at|bl|iz)$') THEN {x} || 'e' WHEN regexp_matches({x}, '[^aeioulsz]$') AND right({x}, 1) = right({cut(1, x)}, 1) THEN {cut(1, x)} WHEN {short(x)} THEN {x} || 'e' ELSE {x} END"
    )
    return [
        f"CASE WHEN ends_with(w, 'sses') OR ends_with(w, 'ies') THEN {cut(2)} WHEN ends_with(w, 's') AND NOT ends_with(w, 'ss') THEN {cut(1)} ELSE w END",
        f"CASE WHEN ends_with(w, 'eed') THEN CASE WHEN {more(cut(3), 1)} THEN {cut(1)} ELSE w END WHEN ends_with(w, 'ed') AND {vowel(cut(2))} THEN {tail(cut(2))} WHEN ends_with(w, 'ing') AND {vowel(cut(3))} THEN {tail(cut(3))} ELSE w END",
        f"CASE WHEN ends_with(w, 'y') AND {vowel(cut(1))} THEN {cut(1)} || 'i' ELSE w END",
        suffixes(STEP_2, 1),
        suffixes(STEP_3, 1),
        suffixes(dict.fromkeys(STEP_4, ""), 2),
        f"CASE WHEN ends_with(w, 'e') AND ({more(cut(1), 2)} OR {one(cut(1))} AND NOT {short(cut(1))}) THEN {cut(1)} ELSE w END",
        f"CASE WHEN ends_with(w, 'll') AND {more('w', 2)} THEN {cut(1)} ELSE w END",
    ]


def stems_sql(source: str, name: str = "stems") -> str:
    """CTEs ending in `name` (term, stem): Porter stems of the distinct terms of a source."""
    steps = _porter()
    out = [f"{name}0 AS (SELECT DISTINCT term, CASE WHEN starts_with(term, 'y') THEN 'Y' || substr(term, 2) ELSE term END AS w FROM ({source}) s WHERE regexp_matches(term, '^[a-z]{{3,}}$'))"]
    out += [f"{name}{k + 1} AS (SELECT term, {step} AS w FROM {name}{k})" for k, step in enumerate(steps)]
    out.append(f"{name} AS (SELECT term, lower(w) AS stem FROM {name}{len(steps)} UNION ALL SELECT DISTINCT term, term FROM ({source}) s WHERE NOT regexp_matches(term, '^[a-z]{{3,}}$'))")
    return ",\n".join(out)


#: The same over stems: what a search of the stemmed index finds.
STEMMED_SQL = f"""{stems_sql("SELECT term FROM toks UNION SELECT term FROM best")},
stf AS (SELECT id, stem AS term, sum(tf) AS tf FROM tf JOIN stems USING (term) GROUP BY id, stem),
sdf AS (SELECT term, count(*) AS df FROM stf GROUP BY term),
sqt AS (SELECT item_id AS query_id, stem AS term, count(*) AS times, count(*) OVER (PARTITION BY item_id) AS terms FROM best JOIN stems USING (term) GROUP BY item_id, stem)"""


def chunks(spark: SparkSession, sf_dir: str, many: bool = False) -> DataFrame:
    """(chunk_id, id, chunk_index, embedding); with `many`, several chunks per record."""
    v = F.col("vec_id")
    id_, index = (F.floor(v / 4), v % 4) if many else (v, F.lit(0))
    return table(spark, sf_dir, "embeddings").select(v.alias("chunk_id"), id_.alias("id"), index.cast("int").alias("chunk_index"), "embedding")


def knn_sql(k: int, many: bool, name: str = "nn") -> str:
    id_ = "e.vec_id // 4" if many else "e.vec_id"
    return f"""{name} AS (SELECT query_id, e.vec_id AS chunk_id, {id_} AS id, list_distance(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS distance,
    row_number() OVER (PARTITION BY query_id ORDER BY round(list_distance(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6), e.vec_id) AS rank
  FROM embeddings e, (SELECT query_id, embedding FROM queries JOIN embeddings ON vec_id = query_id) q QUALIFY rank <= {k})"""


def exposures(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_type")
    kind = F.when(e.isin("view", "click", "signup"), "search").when(e == "purchase", "get").otherwise("other")
    rank = F.when(e.isin("view", "click"), (1 + F.col("event_id") % 10).cast("int"))
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "ts", F.col("user_id").alias("memory_id"), kind.alias("kind"), rank.alias("rank"))


EXPOSURES_SQL = """log AS (SELECT event_id AS id, ts, user_id AS memory_id,
    CASE WHEN event_type IN ('view','click','signup') THEN 'search' WHEN event_type = 'purchase' THEN 'get' ELSE 'other' END AS kind,
    CASE WHEN event_type IN ('view','click') THEN (1 + event_id % 10)::INT END AS rank FROM events)"""


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, title, body, tags, created, updated, n_turns) from conversations."""
    from ..operators import hygiene

    c = F.col("conv_id")
    built = hygiene.transcripts(table(spark, sf_dir, "conversations"))
    created = now() - F.make_dt_interval((c * 7 % 60).cast("int"))
    tags = F.array(F.concat(F.lit("agent:"), (c % 3).cast("string")), F.concat(F.lit("home-"), (c % 12).cast("string")))
    return built.select(c.alias("id"), F.concat(F.lit("session "), c.cast("string")).alias("title"), "body", tags.alias("tags"), created.alias("created"), (created + F.make_dt_interval((c % 4).cast("int"))).alias("updated"), "n_turns")


SESSIONS_SQL = f"""sessions AS (SELECT conv_id AS id, 'session ' || conv_id::VARCHAR AS title,
    string_agg('**' || upper(substr(role, 1, 1)) || substr(role, 2) || ':** ' || text, chr(10) || chr(10) ORDER BY turn) AS body,
    ['agent:' || (conv_id % 3)::VARCHAR, 'home-' || (conv_id % 12)::VARCHAR] AS tags,
    TIMESTAMP '{NOW_TEXT}' - to_days((conv_id * 7 % 60)::INT) AS created,
    TIMESTAMP '{NOW_TEXT}' - to_days((conv_id * 7 % 60)::INT) + to_days((conv_id % 4)::INT) AS updated, count(*)::INT AS n_turns
  FROM conversations WHERE role IN ('user','assistant') AND trim(text) <> '' GROUP BY conv_id)"""


def noisy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """records with noise put in by id."""
    i, body = F.col("id"), F.col("body")
    dump = F.repeat(F.lit('{"type": "tool", "content": "0123456789"}\n'), 8)
    noise = F.when(i % 97 == 0, F.concat(F.lit("HEARTBEAT_OK\n"), body)).when(i % 89 == 0, F.concat(F.lit("Running cron job: x\n"), body)).when(i % 83 == 0, dump).when(i % 79 == 0, F.concat(body, F.lit(" deploy the site by friday"))).otherwise(body)
    ref = F.when(i % 73 == 0, F.concat(F.lit("/srv/monitoring/"), i.cast("string"))).otherwise(F.col("ref"))
    return records(spark, sf_dir).withColumn("body", noise).withColumn("ref", ref)


NOISY_SQL = """noisy AS (SELECT * REPLACE (
    CASE WHEN id % 97 = 0 THEN 'HEARTBEAT_OK' || chr(10) || body WHEN id % 89 = 0 THEN 'Running cron job: x' || chr(10) || body
      WHEN id % 83 = 0 THEN repeat('{"type": "tool", "content": "0123456789"}' || chr(10), 8)
      WHEN id % 79 = 0 THEN body || ' deploy the site by friday' ELSE body END AS body,
    CASE WHEN id % 73 = 0 THEN '/srv/monitoring/' || id::VARCHAR ELSE ref END AS ref) FROM records)"""


def linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """records with wikilinks, images and paragraphs put in by id."""
    i = F.col("id")
    body = F.when(i % 2 == 0, F.replace("body", F.lit("\n"), F.lit("\n\n"))).otherwise(F.col("body"))
    body = F.when(i % 10 == 0, F.concat(body, F.lit(" [[doc-"), i.cast("string"), F.lit("]] [[ Other ]]"))).otherwise(body)
    body = F.when(i % 12 == 0, F.concat(body, F.lit(' ![a](img/a.png) <img src="b.jpg"> ![c](http://x/y.png)'))).otherwise(body)
    return records(spark, sf_dir).withColumn("body", body)


LINKED_SQL = """linked0 AS (SELECT * REPLACE (CASE WHEN id % 2 = 0 THEN replace(body, chr(10), chr(10) || chr(10)) ELSE body END AS body) FROM records),
linked1 AS (SELECT * REPLACE (CASE WHEN id % 10 = 0 THEN body || ' [[doc-' || id::VARCHAR || ']] [[ Other ]]' ELSE body END AS body) FROM linked0),
linked AS (SELECT * REPLACE (CASE WHEN id % 12 = 0 THEN body || ' ![a](img/a.png) <img src="b.jpg"> ![c](http://x/y.png)' ELSE body END AS body) FROM linked1)"""


def chunked_sql(source: str) -> str:
    """CTEs ending in `cut` (id, cs): the chunks of the bodies of a source."""
    flushed = "CASE WHEN acc.open <> '' THEN list_append(acc.done, acc.open) ELSE acc.done END"
    joined = "CASE WHEN acc.open = '' THEN x.open ELSE acc.open || chr(10) || chr(10) || x.open END"
    trimmed = lambda x: f"trim({x}, E' \\n\\t\\r')"
    return f"""paras AS (SELECT id, body, list_filter(list_transform(string_split(body, chr(10) || chr(10)), lambda p: {trimmed("p")}), lambda p: p <> '') AS ps FROM {source}),
packed AS (SELECT id, body, list_reduce(list_prepend({{'done': []::VARCHAR[], 'open': ''}}, list_transform(ps, lambda p: {{'done': []::VARCHAR[], 'open': p}})), lambda acc, x: CASE
    WHEN length(x.open) > 2048 THEN {{'done': list_concat({flushed}, list_transform(range(0, (length(x.open) - 1) // 2048 + 1), lambda i: substr(x.open, i * 2048 + 1, 2048))), 'open': ''}}
    WHEN length({joined}) > 2048 THEN {{'done': {flushed}, 'open': x.open}} ELSE {{'done': acc.done, 'open': {joined}}} END) AS acc FROM paras),
cut AS (SELECT id, CASE WHEN {trimmed("body")} = '' THEN [] WHEN length(body) <= 2048 THEN [{trimmed("body")}] ELSE {flushed} END AS cs FROM packed)"""
