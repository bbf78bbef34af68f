"""Queries of vocabularies, losses, sweeps and samples."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .functions.tokens import Vocabulary
from .operators import metrics, reasoning
from .plans.lineage import Scratch
from .registered import query, read

VOCABULARIES = "/opt/tokenizers"

# Words of documents as one stream a language, each with the loss of an add-one unigram model.
_STREAM = r"""w AS (SELECT lang, doc_id, unnest(list_filter(string_split_regex(trim(coalesce(text, '')), '\s+'), lambda x: x <> '')) AS w, generate_subscripts(list_filter(string_split_regex(trim(coalesce(text, '')), '\s+'), lambda x: x <> ''), 1) AS i FROM documents),
a AS (SELECT w, count(*) AS c FROM w GROUP BY w), t AS (SELECT sum(c) AS total, count(*) AS kinds FROM a),
s AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id, i) - 1 AS pos, -ln((c + 1) / (total + kinds)) AS loss FROM w JOIN a USING (w), t)"""


def _words():
    return F.filter(F.split(F.trim(F.coalesce("text", F.lit(""))), r"\s+"), lambda x: x != "")


@query(f"""WITH {_STREAM}, n AS (SELECT lang, count(*) AS n FROM s GROUP BY lang), b AS (SELECT lang, CAST(sum(strlen(text)) AS BIGINT) AS bytes FROM documents GROUP BY lang),
f AS (SELECT lang, sum(loss) AS loss, count(*) AS tokens FROM s JOIN n USING (lang) WHERE pos >= 1 AND pos <= (n - 1) // 256 * 256 GROUP BY lang)
SELECT lang, tokens, bytes, round(loss / tokens, 6) AS cross_entropy, round(exp(loss / tokens), 4) AS perplexity, round(loss * log2(exp(1)) / bytes, 6) AS bits_per_byte FROM f JOIN b USING (lang)""")
def windowed_cross_entropy(spark, sf_dir):
    """Losses of all tokens by counts of words, without those of each stream's first token and of what full windows leave."""
    docs = read(spark, sf_dir, "documents").select("lang", "doc_id", "text")
    losses, sums = metrics.unigram_model(docs, "lang", _words())
    upto = F.floor((F.col("tokens") - 1) / 256) * 256
    left = sums.where("tokens > 0").select("lang", F.explode(F.array_union(F.array(F.lit(0).cast("long")), F.when(upto + 1 < F.col("tokens"), F.sequence(upto + 1, F.col("tokens") - 1)).otherwise(F.array()))).alias("pos"))
    places = metrics.placed(docs, "lang", "doc_id", _words())
    out = metrics.words_at(docs, "lang", "doc_id", _words(), places, left).join(losses, "w").groupBy("lang").agg(F.sum("loss").alias("out"))
    bytes_ = docs.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("bytes"))
    kept = sums.join(out, "lang").select("lang", (F.col("loss") - F.col("out")).alias("loss"), upto.alias("tokens"))
    got = metrics.perplexity(kept.join(bytes_, "lang"))
    return got.select("lang", "tokens", "bytes", "cross_entropy", F.round("perplexity", 4).alias("perplexity"), "bits_per_byte")


@query(f"""WITH {_STREAM}, z AS (SELECT lang, count(*) AS n FROM s GROUP BY lang), d AS (SELECT lang, n, ((i * 2654435761 + 97) % 4294967296) * (n - 64) // 4294967296 AS a FROM z, range(320) x(i) WHERE n > 64),
k AS (SELECT lang, p AS pos, count(*) AS k FROM (SELECT lang, unnest(range(a + 1, a + 65)) AS p FROM d) GROUP BY ALL),
r AS (SELECT lang, sum(loss * k) AS loss, CAST(sum(k) AS BIGINT) AS tokens FROM s JOIN k USING (lang, pos) GROUP BY lang)
SELECT lang, round(loss / tokens, 6) AS loss, tokens, round(exp(loss / tokens), 4) AS perplexity, reach FROM r JOIN (SELECT lang, min(a) * 10 < any_value(n) AND max(a) * 10 >= any_value(n) * 9 AS reach FROM d GROUP BY lang) USING (lang)""")
def sampled_validation_perplexity(spark, sf_dir):
    """320 windows of 64 tokens of each language's whole stream; reach: whether draws come to its first and last tenth."""
    docs = read(spark, sf_dir, "documents").select("lang", "doc_id", "text")
    losses, sums = metrics.unigram_model(docs, "lang", _words())
    starts = Scratch(spark).written(metrics.random_starts(sums.select("lang", F.col("tokens").alias("n")), 320, 64), "starts")
    places = metrics.placed(docs, "lang", "doc_id", _words())
    drawn = metrics.words_at(docs, "lang", "doc_id", _words(), places, metrics.drawn_places(starts, "lang", 64)).join(losses, "w")
    got = drawn.groupBy("lang").agg(F.sum(F.col("loss") * F.col("k")).alias("loss"), F.sum("k").alias("tokens"))
    mean = F.col("loss") / F.col("tokens")
    reach = starts.groupBy("lang").agg(((F.min("start") * 10 < F.first("n")) & (F.max("start") * 10 >= F.first("n") * 9)).alias("reach"))
    return got.select("lang", F.round(mean, 6).alias("loss"), "tokens", F.round(F.exp(mean), 4).alias("perplexity")).join(F.broadcast(reach), "lang")


@query()
def vocabulary_sweep(spark, sf_dir):
    candidates = {n: Vocabulary(f"{VOCABULARIES}/{n}") for n in ("piece_bpe_32k.model", "byte_bpe_50k.json", "word_bpe_49k.json")}
    return metrics.vocabulary_sweep(read(spark, sf_dir, "documents"), "text", candidates)


@query()
def token_round_trip(spark, sf_dir):
    v = Vocabulary(f"{VOCABULARIES}/byte_bpe_50k.json")
    rows = read(spark, sf_dir, "documents").select("doc_id", "text", v.encode(F.col("text")).alias("ids"))
    return rows.select("doc_id", F.size("ids").alias("n"), (v.decode(F.col("ids")) == F.col("text")).alias("same"))


@query("""SELECT lang, round(sum(CASE WHEN w > 0 THEN t END) / sum(w), 6) AS fertility, round(sum(u) / sum(t), 6) AS unk_rate FROM (
SELECT lang, len(coalesce(text, '')) AS t, len(regexp_extract_all(coalesce(text, ''), '\\S+')) AS w, len(coalesce(text, '')) - len(regexp_extract_all(coalesce(text, ''), '[\\x00-\\x7F]')) AS u FROM documents) GROUP BY lang""")
def character_fertility(spark, sf_dir):
    """Fertility and unknown rate of the vocabulary of all ASCII characters."""
    t = F.coalesce("text", F.lit(""))
    rows = read(spark, sf_dir, "documents").select("lang", F.length(t).alias("n_tokens"), F.regexp_count(t, F.lit(r"\S+")).alias("n_words"), F.regexp_count(t, F.lit(r"[^\x00-\x7F]")).alias("n_unk"))
    return metrics.fertility(rows, "lang")


@query(r"""WITH c AS (SELECT char, count(*) AS n FROM (SELECT unnest(string_split(text, '')) AS char FROM documents) WHERE NOT regexp_matches(char, '^\s*$') GROUP BY char)
SELECT char, n FROM (SELECT *, coalesce(sum(n) OVER (ORDER BY n DESC, char ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(n) OVER () AS total FROM c) WHERE before < total * 0.9995""")
def character_coverage(spark, sf_dir):
    return metrics.character_coverage(read(spark, sf_dir, "documents"), "text")


@query("SELECT split, round(avg(v), 4) AS accuracy FROM (SELECT l_returnflag AS split, l_linenumber AS seed, round(avg(l_discount), 4) AS v FROM lineitem GROUP BY ALL) GROUP BY split")
def seed_means(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("split"), F.col("l_linenumber").alias("seed")).agg(F.avg("l_discount").alias("accuracy"))
    return metrics.seed_means(rows, "split", "accuracy")


@query("""WITH s AS (SELECT turn AS lr, conv_id AS step, CASE WHEN turn = 5 AND length(text) % 97 = 0 THEN 'NaN'::DOUBLE ELSE length(text) END AS loss FROM conversations),
r AS (SELECT *, row_number() OVER (PARTITION BY lr ORDER BY step) AS a, row_number() OVER (PARTITION BY lr ORDER BY step DESC) AS z FROM s),
g AS (SELECT lr, avg(loss) FILTER (a <= 10) AS f, avg(loss) FILTER (z <= 10) AS l, count(*) FILTER (isnan(loss) OR isinf(loss)) AS bad FROM r GROUP BY lr)
SELECT arg_min(lr, l) AS lr, round(min(l), 6) AS loss FROM g WHERE bad = 0 AND l < f""")
def best_rate(spark, sf_dir):
    """Turns as rates and conversations as steps: the rate whose last steps say least, if they say less than its first."""
    loss = F.when((F.col("turn") == 5) & (F.length("text") % 97 == 0), float("nan")).otherwise(F.length("text").cast("double"))
    return metrics.best_rate(read(spark, sf_dir, "conversations").select(F.col("turn").alias("lr"), F.col("conv_id").alias("step"), loss.alias("loss")))


@query("SELECT doc_id AS step, CASE WHEN doc_id < 20 THEN 0.001 * (doc_id + 1) / 20 ELSE 0.001 END AS lr FROM labels")
def finetune_schedule(spark, sf_dir):
    """The rate at each labelled document: constant after the warm-up."""
    return read(spark, sf_dir, "labels").select(F.col("doc_id").alias("step"), metrics.learning_rate(F.col("doc_id"), 0.001, None, 20, 60).alias("lr"))


@query("""WITH e AS (SELECT vec_id, embedding AS v, range(len(embedding)) AS places FROM embeddings),
s AS (SELECT vec_id AS example, vec_id % 2 AS layer, vec_id // 2 % 2 AS head, q, k, exp(CAST(v[q+1] AS DOUBLE) * CAST(v[k+1] AS DOUBLE)) AS x FROM (SELECT *, unnest(places) AS q FROM e), range(64) b(k) WHERE k <= q),
p AS (SELECT *, x / sum(x) OVER (PARTITION BY example, q) AS p FROM s), h AS (SELECT layer, head, example, q, sum(-p * ln(p + 1e-12)) AS h, sum(p * (q - k)) AS d FROM p WHERE q >= 1 GROUP BY ALL),
x AS (SELECT layer, head, example, avg(h) AS h, avg(d) AS d FROM h GROUP BY ALL), m AS (SELECT layer, head, round(avg(h), 6) AS h, round(avg(d), 6) AS d FROM x GROUP BY ALL)
SELECT layer, round(avg(h), 4) AS entropy, round(avg(d), 4) AS distance FROM m GROUP BY layer""")
def attention_by_layer(spark, sf_dir):
    from .catalog import _heads

    got = metrics.layer_means(metrics.head_summary(_heads(spark, sf_dir)))
    return got.select("layer", F.round("entropy", 4).alias("entropy"), F.round("distance", 4).alias("distance"))


@query("""SELECT o_orderpriority AS split, count(*) AS total, count(DISTINCT (o_custkey % 4, o_orderkey % 3)) AS form_pairs, string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) AS domains,
string_agg(DISTINCT CAST(2 + o_custkey % 3 AS VARCHAR), ',' ORDER BY CAST(2 + o_custkey % 3 AS VARCHAR)) AS depths, count(*) FILTER (o_orderkey % 6 = 0) AS ties FROM orders GROUP BY 1""")
def variety_of_rows(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("split"), (F.col("o_custkey") % 4).alias("premise_form_id"), (F.col("o_orderkey") % 3).alias("question_form_id"),
        F.col("o_orderstatus").alias("domain"), (2 + F.col("o_custkey") % 3).alias("num_entities"), (F.col("o_orderkey") % 6 == 0).alias("has_tie"),
    )
    return reasoning.variety(rows)


@query("""WITH h AS (SELECT o_orderkey, ('0x' || substr(md5(o_orderkey || ':0'), 1, 15))::BIGINT AS h FROM orders), r AS (SELECT o_orderkey, h % 64 AS part, row_number() OVER (PARTITION BY h % 64 ORDER BY h, o_orderkey) - 1 AS i FROM h),
s AS (SELECT part, coalesce(sum(n) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first FROM (SELECT part, (count(*) + 31) // 32 AS n FROM r GROUP BY part))
SELECT o_orderkey, CAST(first + i // 32 AS BIGINT) AS batch, i % 32 AS place FROM r JOIN s USING (part)""")
def shuffled_batches(spark, sf_dir):
    """The whole order: each row's batch and its place there."""
    return reasoning.shuffled(read(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 32)


@query("""SELECT conv_id, turn, strict, lenient FROM (SELECT conv_id, turn, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS e, trim(text) = trim(e) AS strict, starts_with(trim(text), trim(e)) AS lenient FROM conversations) WHERE e IS NOT NULL""")
def answers_against_the_turn_before(spark, sf_dir):
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = read(spark, sf_dir, "conversations").withColumn("e", F.lag("text").over(w)).where("e is not null")
    return rows.select("conv_id", "turn", (F.trim("text") == F.trim("e")).alias("strict"), F.trim("text").startswith(F.trim("e")).alias("lenient"))


@query(r"""WITH t AS (SELECT doc_id, list_append(list_transform(regexp_extract_all(coalesce(text, ''), '[^ \t\n\v\f\r]+'), lambda w: (unicode(w) * 64 + len(w)) % 65536), 0) AS ids FROM documents),
s AS (SELECT row_number() OVER (ORDER BY doc_id, i) - 1 AS p, id FROM (SELECT doc_id, unnest(ids) AS id, generate_subscripts(ids, 1) AS i FROM t))
SELECT p // 1024 * 1024 AS pos, count(*) AS n, CAST(sum(id) AS BIGINT) AS total, CAST(sum(id * (p % 1024 + 1)) AS BIGINT) AS by_place FROM s GROUP BY 1""")
def token_file_windows(spark, sf_dir):
    """Words as 16-bit ids by their first letter and length, an id 0 after each document: written as token files, and
    read back as windows of one stream."""
    from .sources.tokenfiles import read_tokens, write_tokens

    ids = F.transform(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[^ \t\n\x0B\f\r]+"), 0), lambda w: (F.ascii(w) * 64 + F.length(w)) % 65536)
    path = f"{Scratch(spark).place}/tokens"
    write_tokens(read(spark, sf_dir, "documents").select("doc_id", F.array_append(ids, F.lit(0)).alias("ids")), path, "doc_id")
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda x, y: x + y)
    return read_tokens(spark, path).select("pos", F.size("ids").cast("long").alias("n"), total("ids").alias("total"), total(F.transform("ids", lambda x, i: x.cast("long") * (i + 1))).alias("by_place"))


_TURNS = "SELECT conv_id AS key, turn AS pos, length(text) % 3 = 0 AS ok, length(text) AS tokens FROM conversations"


def _turns(spark, sf_dir):
    """Turns of conversations as a stream of attempts; their numbers stand for the time, of
    which no watermark is behind."""
    from .streaming import stateful

    rows = stateful.source(spark, f"{sf_dir}/conversations.parquet")
    return rows.select(F.col("conv_id").alias("key"), F.col("turn").alias("pos"), (F.length("text") % 3 == 0).alias("ok"), F.length("text").cast("long").alias("tokens"), F.timestamp_seconds(F.col("turn") + 86400).alias("at"))


@query(f"WITH a AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY pos) AS n FROM ({_TURNS}) QUALIFY n <= 2) SELECT key, CAST(coalesce(min(n) FILTER (ok), max(n)) AS BIGINT) AS tries, CASE WHEN bool_or(ok) THEN 'done' WHEN max(n) < 2 THEN 'retry' ELSE 'given_up' END AS state FROM a GROUP BY key")
def streamed_retries(spark, sf_dir):
    from .streaming import stateful

    return stateful.final(stateful.once(spark, stateful.retries(_turns(spark, sf_dir))))


@query(f"SELECT key, pos FROM ({_TURNS}) QUALIFY row_number() OVER (PARTITION BY key ORDER BY pos) <= 3")
def streamed_caps(spark, sf_dir):
    from .streaming import stateful

    return stateful.once(spark, stateful.capped(_turns(spark, sf_dir).select("key", "pos", "at"), "key", "pos", 3)).select("key", "pos")


@query(f"""WITH RECURSIVE t AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY pos) AS i FROM ({_TURNS})),
f AS (SELECT key, pos, tokens, i, 0 AS shard, tokens AS held FROM t WHERE i = 1 UNION ALL
SELECT t.key, t.pos, t.tokens, t.i, CASE WHEN f.held >= 900 THEN f.shard + 1 ELSE f.shard END, CASE WHEN f.held >= 900 THEN t.tokens ELSE f.held + t.tokens END FROM f JOIN t ON t.key = f.key AND t.i = f.i + 1)
SELECT key, pos, tokens, CAST(shard AS BIGINT) AS shard FROM f""")
def streamed_shards(spark, sf_dir):
    from .streaming import stateful

    got = stateful.once(spark, stateful.sharded(_turns(spark, sf_dir).select("key", "pos", "tokens", "at"), "key", "pos", "tokens", 900))
    return got.select("key", "pos", "tokens", "shard")


@query("""SELECT part, pos, length(trim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) AS chars FROM (SELECT CASE WHEN lang = 'en' THEN 'verified' ELSE 'unverified' END AS part, text,
row_number() OVER (PARTITION BY lang = 'en' ORDER BY doc_id) - 1 AS pos FROM documents) WHERE regexp_matches(text, '[^ \\t\\n\\v\\f\\r]')""")
def dataset_scan(spark, sf_dir):
    """Documents exported as a dataset of two parts, and scanned by a stream in micro-batches of 100,000 documents."""
    from .streaming import dataset

    place, docs = Scratch(spark).place, read(spark, sf_dir, "documents")
    for part, wanted in (("verified", F.col("lang") == "en"), ("unverified", ~F.col("lang").eqNullSafe("en"))):
        docs.where(wanted).select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id").write.parquet(f"{place}/dataset/{part}")
    dataset.scan(spark, f"{place}/dataset", f"{place}/scanned", f"{place}/checkpoint", rows=100_000)
    return spark.read.schema(dataset.SCHEMA).parquet(f"{place}/scanned").select("part", "pos", F.length("text").cast("long").alias("chars"))


@query("""WITH g AS (SELECT conv_id, turn, list(role) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS g FROM conversations)
SELECT array_to_string(g, ' ') AS roles, count(*) AS n, count(DISTINCT conv_id) AS conversations FROM g WHERE len(g) = 3 GROUP BY 1""")
def role_trigrams(spark, sf_dir):
    """Roles of three turns in a row, by a table function over conversations, called from SQL."""
    from .functions import udtfs

    udtfs.register(spark)
    read(spark, sf_dir, "conversations").select("conv_id", "turn", "role").createOrReplaceTempView("granary_turns")
    return spark.sql("SELECT array_join(gram, ' ') AS roles, count(*) AS n, count(DISTINCT conv_id) AS conversations FROM ngrams(3, TABLE(granary_turns) PARTITION BY conv_id ORDER BY turn) GROUP BY 1")
