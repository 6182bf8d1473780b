"""Queries of the audit operators over the driver's tables, each beside its SQL where SQL can say it.

Stand-ins: orders are submissions (customer = owner, priority = lab, price = score), documents are submissions with one
file (source = owner, language = lab), conversations are bundles (turns = files), pages are workspaces, events are run
events, labels are verdicts, benchmark texts are the baseline.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import hashing
from .functions import text as T
from .operators import bundles, delta, evidence, identity, nested, payloads, reports, rules, runs, scope, selection, similarity, target_index, verdicts, workspace
from .sources import envelopes
from .storage import adopt, shared_dir, staged
from .streaming import latest, run_states

_QUERIES: dict = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries():
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# --- selection -------------------------------------------------------------------------------------------------------

CUTOFF, SCORE, LABS = "1997-06-30", 50_000, ("1-URGENT", "2-HIGH", "5-LOW")
_SUBS = "SELECT o_orderkey id, o_custkey AS owner, o_orderpriority lab_id, o_totalprice score, o_orderdate submitted_at, o_orderstatus status FROM orders"
_ELIGIBLE = f"SELECT * FROM ({_SUBS}) WHERE status='F' AND score>={SCORE} AND submitted_at<=TIMESTAMP '{CUTOFF}'"


def submissions(spark, d):
    return t(spark, d, "orders").selectExpr("o_orderkey id", "o_custkey owner", "o_orderpriority lab_id", "o_totalprice score", "o_orderdate submitted_at", "o_orderstatus status")


def history(spark, d, **kw):
    return selection.eligible(submissions(spark, d), SCORE, F.lit(CUTOFF).cast("timestamp_ntz"), status="F", **kw)


def _dated(df):
    return df.withColumn("submitted_at", F.date_format("submitted_at", "yyyy-MM-dd"))


_DATED = "strftime(submitted_at, '%Y-%m-%d') submitted_at"


@query(f"SELECT id, owner, lab_id, score, {_DATED}, status FROM ({_ELIGIBLE}) WHERE lab_id IN {LABS}")
def eligible_snapshot(spark, d):
    return _dated(selection.snapshot(history(spark, d, labs=LABS)))


@query(f"SELECT id, owner, lab_id, score FROM (SELECT *, row_number() OVER (PARTITION BY owner, lab_id ORDER BY score DESC, submitted_at DESC, id DESC) r FROM ({_ELIGIBLE})) WHERE r=1")
def best_per_owner_lab(spark, d):
    return selection.best(history(spark, d)).select("id", "owner", "lab_id", "score")


@query(f"SELECT owner, lab_id, id, score FROM ({_ELIGIBLE}) ORDER BY owner, lab_id, submitted_at, id LIMIT 25")
def limited_snapshot(spark, d):
    """The limit is the feature: a request's row limit in catalogue order."""
    return selection.snapshot(history(spark, d), 25).select("owner", "lab_id", "id", "score")


_RUNS = "SELECT l_orderkey run_id, count(*) n_steps, round(sum(l_quantity), 2) AS performance FROM lineitem GROUP BY l_orderkey"


def _runs(spark, d):
    return t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("run_id")).agg(F.count("*").alias("n_steps"), F.round(F.sum("l_quantity"), 2).alias("performance"))


@query(f"WITH b AS (SELECT owner, lab_id, max(score) best_score, arg_max(id, (score, submitted_at, id)) submission_id FROM ({_ELIGIBLE}) GROUP BY 1, 2) SELECT b.submission_id, b.best_score, s.owner, s.lab_id, r.n_steps, r.performance FROM b JOIN ({_SUBS}) s ON s.id=b.submission_id JOIN ({_RUNS}) r ON r.run_id=s.id")
def authoritative_best_join(spark, d):
    best = selection.best(history(spark, d)).select(F.col("id").alias("submission_id"), F.col("score").alias("best_score"))
    subs = submissions(spark, d).withColumn("active_run_id", F.col("id"))
    return selection.authoritative_best(best, subs, _runs(spark, d)).select("submission_id", "best_score", "owner", "lab_id", "n_steps", "performance")


@query(f"SELECT s.id, s.owner, r.n_steps, r.performance FROM ({_SUBS}) s LEFT JOIN ({_RUNS}) r ON r.run_id=s.id")
def snapshot_with_runs(spark, d):
    return selection.with_runs(submissions(spark, d).withColumn("active_run_id", F.col("id")), _runs(spark, d)).select("id", "owner", "n_steps", "performance")


@query(f"WITH b AS (SELECT owner, lab_id, max(score) best_score FROM ({_SUBS}) WHERE status='F' GROUP BY 1, 2) SELECT s.id, b.best_score FROM ({_SUBS}) s JOIN b USING (owner, lab_id) WHERE s.status='F' AND b.best_score>=200000")
def policy_score_filter(spark, d):
    subs = submissions(spark, d).filter("status = 'F'")
    best = subs.groupBy("owner", "lab_id").agg(F.max("score").alias("best_score"))
    return subs.join(best, ["owner", "lab_id"]).filter(selection.policy_score("best_only") >= 200_000).select("id", "best_score")


@query(f"WITH h AS ({_ELIGIBLE}), b AS (SELECT owner, lab_id, arg_max(id, (score, submitted_at, id)) id FROM h GROUP BY 1, 2) SELECT (SELECT count(*) FROM b) best_rows, (SELECT count(DISTINCT owner) FROM b) best_owners, (SELECT count(*) FROM h) history_rows, (SELECT count(DISTINCT owner) FROM h) history_owners, (SELECT round(sum(score), 2) FROM h) history_score")
def corpus_counts(spark, d):
    h = history(spark, d)
    return selection.corpus_counts(selection.best(h), h).withColumn("history_score", F.round("history_score", 2))


@query("SELECT sha256(o_orderpriority || chr(0) || o_orderstatus) fingerprint, o_orderpriority, o_orderstatus FROM orders GROUP BY ALL")
def lab_definitions(spark, d):
    return selection.definition_rows(t(spark, d, "orders"), "o_orderpriority", "o_orderstatus")


# --- documents as submissions ----------------------------------------------------------------------------------------

_TOKEN = r"[A-Za-z_][\p{L}\p{N}_]*|0[xX][0-9A-Fa-f]+|\p{Nd}+(?:\.\p{Nd}+)?|==|!=|<=|>=|->|::|&&|\|\||<<|>>|[^\s\x0b\x1c-\x1f\x{85}\p{Z}]"
_TOKENS = f"SELECT doc_id, lang, source, text, sha256(coalesce(text, '')) digest, regexp_extract_all(coalesce(text, ''), '{_TOKEN}') tk FROM documents"
_LED = f"SELECT *, CASE WHEN len(tk)>0 THEN list_concat(['__file__', 'document.txt'], tk) ELSE [] END lt FROM ({_TOKENS})"
_SHINGLES = f"SELECT doc_id, lang, source, digest, CASE WHEN len(lt)=0 THEN [] WHEN len(lt)<5 THEN [array_to_string(lt, chr(31))] ELSE list_distinct(list_transform(generate_series(1, len(lt)-4), lambda i: array_to_string(lt[i:i+4], chr(31)))) END sh FROM ({_LED})"
_EXPLODED = f"SELECT doc_id, lang, source, digest, len(sh) n, hash(unnest(sh)) s FROM ({_SHINGLES})"
_JACCARD = f"e AS (SELECT * FROM ({_EXPLODED})), m AS (SELECT a.lang, a.doc_id x, b.doc_id y, a.digest dx, b.digest dy, count(*)::DOUBLE / (a.n + b.n - count(*)) jaccard FROM e a JOIN e b ON a.s=b.s AND a.lang=b.lang AND a.source<>b.source AND a.doc_id<b.doc_id GROUP BY a.lang, a.doc_id, b.doc_id, a.n, b.n, a.digest, b.digest)"
_REPS = "r AS (SELECT lang, digest, source, min(doc_id) doc_id FROM (SELECT lang, sha256(coalesce(text, '')) digest, source, doc_id FROM documents WHERE coalesce(text, '')<>'') GROUP BY 1, 2, 3)"


def delta_of_documents(spark, d):
    docs = t(spark, d, "documents")
    return docs.select(F.col("doc_id").alias("submission_id"), F.lit("document.txt").alias("path"), F.coalesce("text", F.lit("")).alias("added_text"))


def held_files(spark, d):
    docs = t(spark, d, "documents")
    digest = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    base = docs.select(F.col("doc_id").alias("id"), F.col("source").alias("owner"), F.col("lang").alias("lab_id"), F.col("doc_id").alias("submitted_at"), digest.alias("input_digest"), digest.alias("delta_digest"), (F.coalesce("text", F.lit("")) != "").alias("changed_files"), F.lit(False).alias("incomplete"))
    texts = similarity.file_texts(delta_of_documents(spark, d)).withColumnRenamed("submission_id", "id")
    return base.join(texts, "id", "left")


def entities(spark, d):
    return similarity.with_shingles(held_files(spark, d))


@query(f"SELECT doc_id, len(tk) n_tokens FROM ({_TOKENS})")
def token_counts(spark, d):
    return t(spark, d, "documents").select("doc_id", F.size(T.tokens(F.coalesce("text", F.lit("")))).cast("long").alias("n_tokens"))


@query(f"SELECT doc_id submission_id, len(sh) n_shingles FROM ({_SHINGLES}) WHERE len(sh)>0")
def shingle_counts(spark, d):
    return similarity.shingle_sets(delta_of_documents(spark, d)).select("submission_id", F.size("shingles").cast("long").alias("n_shingles"))


@query("SELECT lang lab_id, sha256(text) input_digest, source AS owner, min(doc_id) id FROM documents WHERE text<>'' GROUP BY 1, 2, 3")
def owner_representatives(spark, d):
    return similarity.representatives(entities(spark, d).filter("changed_files"), "input_digest").select("lab_id", "input_digest", "owner", "id")


@query(f"WITH {_REPS} SELECT a.lang lab_id, least(a.doc_id, b.doc_id) first_id, greatest(a.doc_id, b.doc_id) second_id, 'exact_submission' signal FROM r a JOIN r b ON a.lang=b.lang AND a.digest=b.digest AND a.source<b.source")
def exact_layer_pairs(spark, d):
    return similarity.exact_pairs(entities(spark, d).filter("changed_files"), "input_digest", "exact_submission")


@query(f"WITH {_REPS} SELECT 'exact_duplicate' kind, a.lang lab_id, count(*) n FROM r a JOIN r b ON a.lang=b.lang AND a.digest=b.digest AND a.source<b.source GROUP BY 2")
def exact_duplicate_tasks(spark, d):
    return similarity.exact_pairs(entities(spark, d).filter("changed_files"), "input_digest", "x").groupBy("lab_id").agg(F.count("*").alias("n")).select(F.lit("exact_duplicate").alias("kind"), "lab_id", "n")


@query(f"WITH {_JACCARD} SELECT lang lab_id, x first_id, y second_id, jaccard FROM m WHERE jaccard>=0.7")
def jaccard_pairs(spark, d):
    return similarity.exhaustive_pairs(held_files(spark, d)).select("lab_id", "first_id", "second_id", "jaccard")


_CANDIDATES = f"WITH {_JACCARD}, {_REPS}, p AS (SELECT a.lang, least(a.doc_id, b.doc_id) x, greatest(a.doc_id, b.doc_id) y FROM r a JOIN r b ON a.lang=b.lang AND a.digest=b.digest AND a.source<b.source) SELECT m.lang lab_id, m.x first_id, m.y second_id, CASE WHEN p.x IS NOT NULL THEN 'exact_submission' ELSE 'minhash' END signal, m.jaccard FROM m LEFT JOIN p ON p.x=m.x AND p.y=m.y WHERE m.jaccard>=0.7"


@query(_CANDIDATES)
def similarity_candidates(spark, d):
    return similarity.detect(held_files(spark, d))


@query(f"SELECT lab_id, least(a.source, b.source) owner_a, greatest(a.source, b.source) owner_b, count(*) pairs, max(jaccard) max_jaccard FROM ({_CANDIDATES}) c JOIN documents a ON a.doc_id=c.first_id JOIN documents b ON b.doc_id=c.second_id GROUP BY 1, 2, 3")
def owner_pair_rollup(spark, d):
    e = held_files(spark, d)
    return similarity.owner_pairs(similarity.detect(e, owners=True), e)


@query(f"SELECT kind, count(*) n FROM (SELECT 'plagiarism' kind FROM ({_CANDIDATES}) UNION ALL SELECT 'compliance' FROM documents) GROUP BY 1")
def task_counts(spark, d):
    e = held_files(spark, d)
    return selection.task_counts(similarity.detect(e).select(F.lit("plagiarism").alias("kind")).unionByName(e.select(F.lit("compliance").alias("kind"))))


@query()
def lsh_candidates(spark, d):
    """Bands lose pairs by design, so there is no SQL; a test holds them against the exhaustive pairs."""
    return similarity.detect(held_files(spark, d), mode="lsh")


@query()
def minhash_signatures(spark, d):
    return similarity.with_signatures(held_files(spark, d).select("id", "files")).select("id", hashing.decimal("signature").alias("signature"))


_TARGET = "(SELECT max(doc_id) FROM documents WHERE sha256(text) IN (SELECT sha256(text) FROM documents WHERE text<>'' GROUP BY lang, sha256(text) HAVING count(DISTINCT source)>1))"


_AGAINST = f"WITH {_JACCARD} SELECT lang lab_id, x first_id, y second_id, CASE WHEN dx=dy THEN 'exact_submission' ELSE 'exhaustive_jaccard' END signal, jaccard FROM m WHERE jaccard>=0.7 AND {_TARGET} IN (x, y)"


def _target(e):
    """The last document that another source has too."""
    shared = e.filter("changed_files").groupBy("lab_id", "input_digest").agg(F.count_distinct("owner").alias("n"), F.max("id").alias("id")).filter("n > 1")
    # Known before the rows are read, so that no other document is cut into shingles for it.
    return e.filter(F.col("id") == F.lit(shared.agg(F.max("id")).first()[0]))


@query(_AGAINST)
def target_vs_corpus(spark, d):
    """One document against all of its language."""
    e = entities(spark, d)
    return similarity.target_against(e, _target(e))


@query(_AGAINST)
def target_from_index(spark, d):
    """The same from an index of all documents, made in two additions."""
    import uuid

    path, e = f"{shared_dir(spark)}/target-index-{uuid.uuid4().hex}", entities(spark, d)
    adopt(path, spark)
    for i in (0, 1):
        target_index.add(e.filter(F.pmod(F.xxhash64("id"), F.lit(2)) == i), path, f"half-{i}")
    return target_index.probe(path, _target(e))


@query("SELECT conv_id submission_id, bool_or(r IS NOT NULL) incomplete FROM (SELECT conv_id, CASE WHEN sum(least(strlen(text), 400)) OVER (PARTITION BY conv_id ORDER BY turn)>1500 OR strlen(text)>400 THEN 1 END r FROM conversations) GROUP BY 1 HAVING bool_or(r IS NOT NULL)")
def similarity_exclusions(spark, d):
    b = bundles.totals(bundles.read_budget(_files(spark, d), 400, 1500))
    ex = similarity.exclusions(b.select(F.col("submission_id").alias("id"), F.lit("l").alias("lab_id"), "incomplete"))
    return ex.select(F.col("id").alias("submission_id"), (F.size("skipped_layers") > 0).alias("incomplete"))


# --- deltas ----------------------------------------------------------------------------------------------------------

_BASE = "b AS (SELECT lang, text FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) r FROM documents) WHERE r=1)"
_LINES = "unnest(string_split(regexp_replace(replace(replace(coalesce(text, ''), chr(13)||chr(10), chr(10)), chr(13), chr(10)), '\\n\\z', ''), chr(10)))"


def _baseline(spark, d):
    docs = t(spark, d, "documents")
    first = docs.groupBy("lang").agg(F.min_by(F.struct("text"), "doc_id").alias("_t"))
    return first.select(F.col("lang").alias("lab_id"), F.lit("document.txt").alias("path"), F.col("_t.text").alias("content"), F.lit("r1").alias("revision"), F.lit("course").alias("kind"))


def _doc_files(spark, d):
    docs = t(spark, d, "documents")
    return docs.select(F.col("doc_id").alias("submission_id"), F.col("lang").alias("lab_id"), F.lit("document.txt").alias("path"), F.coalesce("text", F.lit("")).alias("content"), F.lit(None).cast("string").alias("omission_reason"))


@query(f"WITH {_BASE}, n AS (SELECT doc_id, lang, line, count(*) c FROM (SELECT doc_id, lang, {_LINES} line FROM documents) GROUP BY 1, 2, 3), o AS (SELECT lang, line, count(*) c FROM (SELECT lang, {_LINES} line FROM b) GROUP BY 1, 2) SELECT n.doc_id, n.lang, n.line, n.c-coalesce(o.c, 0) surplus FROM n LEFT JOIN o ON o.lang=n.lang AND o.line=n.line WHERE n.c>coalesce(o.c, 0)")
def line_delta_added(spark, d):
    docs = t(spark, d, "documents").select("doc_id", "lang", F.coalesce("text", F.lit("")).alias("text"))
    base = _baseline(spark, d).select(F.col("lab_id").alias("lang"), F.coalesce("content", F.lit("")).alias("text"))
    every = docs.select("doc_id", "lang").join(F.broadcast(base), "lang")  # one row a language
    return delta.line_surplus(docs, every, "doc_id", "lang")


@query(f"WITH {_BASE}, n AS (SELECT doc_id, lang, line, count(*) c FROM (SELECT doc_id, lang, {_LINES} line FROM documents) GROUP BY 1, 2, 3), o AS (SELECT doc_id, lang, line, count(*) c FROM (SELECT d.doc_id, d.lang, {_LINES.replace('text', 'b.text')} line FROM documents d JOIN b ON b.lang=d.lang) GROUP BY 1, 2, 3) SELECT o.doc_id, o.lang, o.line, o.c-coalesce(n.c, 0) surplus FROM o LEFT JOIN n ON o.doc_id=n.doc_id AND o.line=n.line WHERE o.c>coalesce(n.c, 0)")
def line_delta_removed(spark, d):
    docs = t(spark, d, "documents").select("doc_id", "lang", F.coalesce("text", F.lit("")).alias("text"))
    base = _baseline(spark, d).select(F.col("lab_id").alias("lang"), F.coalesce("content", F.lit("")).alias("text"))
    return delta.line_surplus(docs.select("doc_id", "lang").join(F.broadcast(base), "lang"), docs, "doc_id", "lang")


@query()
def line_delta(spark, d):
    """Matching-block diff of every document against its language's first one; tests hold it against difflib."""
    return delta.build(_doc_files(spark, d), _baseline(spark, d))


@query()
def delta_digest(spark, d):
    files = _doc_files(spark, d)
    return delta.digests(delta.build(files, _baseline(spark, d)), files.select("submission_id", F.lit(False).alias("incomplete")))


@query(f"WITH {_BASE} SELECT d.doc_id submission_id, CASE WHEN b.lang IS NULL THEN 'submission_addition' ELSE 'course' END baseline_kind FROM documents d LEFT JOIN b ON b.lang=d.lang WHERE coalesce(d.text, '')<>coalesce(b.text, '')")
def changed_files(spark, d):
    return delta.against_baseline(_doc_files(spark, d), _baseline(spark, d)).filter("content <> baseline_text").select("submission_id", "baseline_kind")


@query("WITH s AS (SELECT DISTINCT conv_id, 'l' lab FROM conversations), w AS (SELECT conv_id, 'turn/'||i||'.txt' path FROM s, range(0, 6) r(i)) SELECT conv_id submission_id, path FROM w WHERE (conv_id, path) NOT IN (SELECT conv_id, 'turn/'||turn||'.txt' FROM conversations)")
def removed_baseline_files(spark, d):
    files = t(spark, d, "conversations").select(F.col("conv_id").alias("submission_id"), F.lit("l").alias("lab_id"), F.format_string("turn/%d.txt", "turn").alias("path"))
    base = spark.range(6).select(F.lit("l").alias("lab_id"), F.format_string("turn/%d.txt", "id").alias("path"))
    return delta.removed_files(files, base, ["turn/*.txt"]).select("submission_id", "path")


_UNIX = "replace(replace(coalesce(text, ''), chr(13)||chr(10), chr(10)), chr(13), chr(10))"


@query(f"""
SELECT doc_id, 1::BIGINT old_start, 0::BIGINT old_count,
    CASE WHEN x='' THEN 0 ELSE len(string_split(regexp_replace(x, '\\n\\z', ''), chr(10))) END::BIGINT new_count,
    strlen(x)::BIGINT bytes
FROM (SELECT doc_id, {_UNIX} x FROM documents)""")
def fallback_hunks(spark, d):
    """A null text is empty; CR and CRLF count as LF."""
    docs = t(spark, d, "documents").select("doc_id", delta.fallback_hunk(F.lit(""), T.unix_newlines(F.coalesce("text", F.lit("")))).alias("h"))
    return docs.select("doc_id", "h.old_start", "h.old_count", "h.new_count", (F.octet_length("h.lines") - F.col("h.new_count")).cast("long").alias("bytes"))


# --- bundles ---------------------------------------------------------------------------------------------------------


def _files(spark, d):
    c = t(spark, d, "conversations")
    return c.select(F.col("conv_id").alias("submission_id"), F.format_string("%05d.txt", "turn").alias("path"), F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("size"), F.coalesce("text", F.lit("")).alias("content"))


_BUDGET = "WITH f AS (SELECT conv_id submission_id, printf('%05d.txt', turn) path, strlen(coalesce(text, ''))::BIGINT size FROM conversations), g AS (SELECT *, least(size, 400) cap, coalesce(sum(least(size, 400)) OVER (PARTITION BY submission_id ORDER BY path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) bef FROM f), h AS (SELECT *, greatest(0, 1500-bef) lft FROM g), r AS (SELECT submission_id, path, size, least(cap, lft)::BIGINT bytes_read, CASE WHEN lft<=0 OR lft<cap THEN 'total_budget' WHEN size>400 THEN 'file_budget' END omission_reason FROM h)"


@query(f"{_BUDGET} SELECT * FROM r")
def byte_budget(spark, d):
    return bundles.read_budget(_files(spark, d), 400, 1500).drop("content")


@query(f"{_BUDGET} SELECT submission_id, count(*) file_count, sum(size)::BIGINT declared_bytes, sum(bytes_read)::BIGINT total_bytes_read, count(omission_reason) truncated_count, bool_or(omission_reason IS NOT NULL) incomplete FROM r GROUP BY 1")
def bundle_totals(spark, d):
    return bundles.totals(bundles.read_budget(_files(spark, d), 400, 1500))


_PATH = r"regexp_extract(url, '^(?:[a-z]+://[^/?#]*)?/?([^?#]*)', 1)"


def _page_path():
    return F.regexp_extract("url", r"^(?:[a-z]+://[^/?#]*)?/?([^?#]*)", 1)


@query(f"SELECT page_id, {_PATH} path FROM pages WHERE regexp_matches({_PATH}, '^(?:en/[^/]*[0-9]|.*/[^/]5[^/]*)$')")
def path_glob_match(spark, d):
    pages = t(spark, d, "pages").select("page_id", _page_path().alias("path"))
    digits = T.matches_any(F.col("path"), [f"en/*{i}" for i in range(10)])
    return pages.filter(digits | T.matches_any(F.col("path"), ["**/?5*"]))


@query(f"SELECT page_id, {_PATH} path, {_PATH}<>'' AND NOT regexp_matches({_PATH}, '(^|/)(\\.|\\.\\.|)(/|$)') AND NOT contains({_PATH}, '\\') safe FROM pages")
def safe_paths(spark, d):
    return t(spark, d, "pages").select("page_id", _page_path().alias("path")).withColumn("safe", T.safe_path(F.col("path")))


@query(f"SELECT page_id, list_filter(string_split(regexp_extract(url, '^(?:[a-z]+://[^/?#]*)?([^?#]*)', 1), '/'), lambda x: x<>'') segments FROM pages")
def url_routes(spark, d):
    return t(spark, d, "pages").select("page_id", T.route(F.col("url")).alias("segments"))


@query("SELECT conv_id submission_id, turn, CASE WHEN turn%7=3 THEN 'repeated path' WHEN role='user' AND turn%5=0 THEN 'bad size' WHEN turn%11=1 THEN 'bad digest' END error FROM conversations UNION ALL SELECT conv_id, turn, 'repeated path' FROM conversations WHERE turn%7=3")
def manifest_validation(spark, d):
    c = t(spark, d, "conversations")
    entry = c.select(F.col("conv_id").alias("submission_id"), "turn", F.format_string("a/%d", "turn").alias("path"), F.when((F.col("role") == "user") & (F.col("turn") % 5 == 0), -1).otherwise(1).alias("size"), F.when(F.col("turn") % 11 == 1, "zz").otherwise(F.sha2(F.lit("x"), 256)).alias("sha256"))
    return bundles.manifest_errors(entry.unionByName(entry.filter("turn % 7 = 3"))).select("submission_id", "turn", "error")


@query("SELECT o_orderkey id, greatest(40000, CASE WHEN o_totalprice>0 THEN floor(o_totalprice)::INT END, CASE WHEN o_custkey-500>0 THEN (o_custkey-500)*100 END)::BIGINT AS file_limit FROM orders")
def effective_limits(spark, d):
    o = t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.floor("o_totalprice").cast("int").alias("a"), ((F.col("o_custkey") - 500) * 100).alias("b"))
    return o.select("id", bundles.effective_limit(40_000, "a", "b").cast("long").alias("file_limit"))


# A client is a lab; the definition that holds is what its last click says, with its letters as globs. What clicks say is at
# times no JSON, no list, or a text where a number belongs.
_LAB_RULES = """
w AS (SELECT client_id lab_id, regexp_replace(arg_max(coalesce(props, ''), (ts, click_id, coalesce(arrived_at, ts), coalesce(props, ''))), '"([a-z])"', '"**\\1*"', 'g') d FROM clicks WHERE client_id IS NOT NULL AND ts IS NOT NULL GROUP BY 1),
j AS (SELECT lab_id, CASE WHEN json_valid(d) THEN d::JSON END d FROM w),
l AS (SELECT lab_id, CASE WHEN json_type(d, '$.tags')='ARRAY' THEN list_transform(list_filter(json_extract(d, '$.tags[*]'), lambda x: json_type(x)='VARCHAR'), lambda x: x->>'$') ELSE [] END pats,
  CASE WHEN json_type(d, '$.k') IN ('UBIGINT', 'BIGINT') THEN (d->>'$.k')::BIGINT END k,
  CASE WHEN json_type(d, '$.items[0].qty') IN ('UBIGINT', 'BIGINT') THEN (d->>'$.items[0].qty')::BIGINT END q FROM j),
r AS (SELECT lab_id, pats, greatest(50, CASE WHEN k>0 THEN k ELSE 0 END) file_limit, greatest(4, CASE WHEN q>0 THEN q ELSE 0 END) total_limit,
  '^('||array_to_string(list_transform(pats, lambda p: replace(replace(replace(p, '**', '@'), '*', '[^/]*'), '@', '.*')), '|')||')$' rx FROM l)"""
_CLICK_RULES = rules.Policy(names=(), suffixes=(".none",), file_bytes=50, total_bytes=4, required="$.tags", allowed="$.more", file_limits=("$.k",), total_limits=("$.items[0].qty",))


def _click_rules(spark, d):
    c = t(spark, d, "clicks").filter("client_id is not null and ts is not null")
    last = c.groupBy(F.col("client_id").alias("lab_id")).agg(F.max(F.struct("ts", "click_id", F.coalesce("arrived_at", "ts").alias("arrived"), F.coalesce("props", F.lit("")).alias("p"))).alias("_l")).select("lab_id", "_l.p")
    return rules.lab_rules(last.withColumn("lab_definition", F.regexp_replace("p", '"([a-z])"', '"**$1*"')), policy=_CLICK_RULES)


@query(f"WITH {_LAB_RULES} SELECT lab_id, array_to_string(pats, ' ') patterns, file_limit, total_limit FROM r")
def lab_rules(spark, d):
    """Patterns and limits of each lab, from its definition's JSON."""
    return _click_rules(spark, d).select("lab_id", F.array_join(F.concat("required", "allowed"), " ").alias("patterns"), "file_limit", "total_limit")


@query(f"""WITH {_LAB_RULES}, f AS (SELECT change_id, client_id, coalesce(source, 'none')||'/'||coalesce(segment, 'none')||'/'||coalesce(city, 'none') p FROM client_changes)
SELECT f.change_id, f.p path, coalesce(r.file_limit, 50) file_limit, coalesce(r.total_limit, 4) total_limit FROM f JOIN r ON r.lab_id=f.client_id WHERE len(r.pats)>0 AND regexp_matches(f.p, r.rx)""")
def lab_source_files(spark, d):
    """The files that their own lab's patterns choose: each change of a client is one, under source/segment/city."""
    part = lambda c: F.coalesce(F.col(c), F.lit("none"))
    files = t(spark, d, "client_changes").select("change_id", F.col("client_id").alias("lab_id"), F.concat_ws("/", part("source"), part("segment"), part("city")).alias("path"))
    return rules.source_files(files, _click_rules(spark, d), _CLICK_RULES).select("change_id", "path", "file_limit", "total_limit")


_GUARDED = """SELECT click_id, CASE WHEN json_type(d, '$.device.os')='VARCHAR' THEN d->>'$.device.os' END os, CASE WHEN json_type(d, '$.k') IN ('UBIGINT', 'BIGINT') THEN (d->>'$.k')::BIGINT END k,
CASE WHEN json_type(d, '$.tags')='ARRAY' THEN array_to_string(list_transform(list_filter(json_extract(d, '$.tags[*]'), lambda x: json_type(x)='VARCHAR'), lambda x: x->>'$'), ',') ELSE '' END tags
FROM (SELECT click_id, CASE WHEN json_valid(props) THEN props::JSON END d FROM clicks)"""


@query(_GUARDED)
def json_guards(spark, d):
    """A value where its kind is the one that belongs there; broken, absent and ill-typed ones are null or empty."""
    v = F.col("v")
    clicks = t(spark, d, "clicks").select("click_id", F.try_parse_json("props").alias("v"))
    return clicks.select("click_id", rules.text_at(v, "$.device.os").alias("os"), rules.whole_at(v, "$.k").alias("k"), F.array_join(rules.texts_at(v, "$.tags"), ",").alias("tags"))


@query("SELECT path, arg_min(src, root_ord) src FROM (SELECT s_nationkey path, 'supplier' src, 0 root_ord FROM supplier UNION ALL SELECT c_nationkey, 'customer', 1 FROM customer UNION ALL SELECT n_nationkey, 'nation', 2 FROM nation) GROUP BY 1")
def multi_root_read(spark, d):
    part = lambda n, c, i: t(spark, d, n).select(F.col(c).alias("path"), F.lit(n).alias("src"), F.lit(i).alias("root_ord"))
    every = part("supplier", "s_nationkey", 0).unionByName(part("customer", "c_nationkey", 1)).unionByName(part("nation", "n_nationkey", 2))
    return bundles.first_root(every, "root_ord", "path").select("path", "src")


@query("SELECT doc_id path, doc_id%3=0 AS missing FROM documents WHERE doc_id%3=0 OR doc_id%10=1")
def verify_copy(spark, d):
    docs = t(spark, d, "documents").select(F.col("doc_id").alias("path"), F.octet_length("text").alias("size"), F.sha2(F.col("text").cast("binary"), 256).alias("sha256"))
    copy = docs.filter("path % 3 <> 0").withColumn("size", F.when(F.col("path") % 10 == 1, F.col("size") + 1).otherwise(F.col("size")))
    return bundles.verify_copy(docs, copy, "path").select("path", (F.col("path") % 3 == 0).alias("missing"))


# --- runs and reports ------------------------------------------------------------------------------------------------

# Event types stand for states: each run is a user, and its events are numbered by time and id.
_EVENTS = "SELECT user_id run_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sequence, event_id updated_at, CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'completed' WHEN 'click' THEN 'preparing' ELSE 'running' END state, CASE WHEN event_type='error' THEN CASE event_id%3 WHEN 0 THEN 'JOB_LOST' WHEN 1 THEN 'MODEL_UNAVAILABLE' ELSE 'RESULT_INVALID' END END error_code, CASE WHEN user_id%2=0 THEN 'manual' ELSE 'nightly' END source FROM events"
_CURRENT = f"c AS (SELECT run_id, arg_max(state, sequence) state, arg_max(updated_at, sequence) updated_at, arg_max(error_code, sequence) FILTER (WHERE true) ec0, max(sequence) AS sequence, count(*) FILTER (WHERE state='preparing') attempts, any_value(source) source FROM ({_EVENTS}) GROUP BY 1), c2 AS (SELECT c.*, e.error_code FROM c JOIN ({_EVENTS}) e ON e.run_id=c.run_id AND e.sequence=c.sequence)"


def _events(spark, d):
    e = t(spark, d, "events")
    state = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "click", "preparing").otherwise("running")
    code = F.when(F.col("event_type") == "error", F.element_at(F.array(F.lit("JOB_LOST"), F.lit("MODEL_UNAVAILABLE"), F.lit("RESULT_INVALID")), (F.col("event_id") % 3 + 1).cast("int")))
    rows = e.select(F.col("user_id").alias("run_id"), "ts", F.col("event_id").alias("updated_at"), state.alias("state"), code.alias("error_code"))
    return runs.sequenced(rows, "ts", "updated_at").drop("ts")


def _current(spark, d):
    return runs.current(_events(spark, d)).withColumn("source", F.when(F.col("run_id") % 2 == 0, "manual").otherwise("nightly"))


@query(f"SELECT run_id, sequence, state, error_code FROM ({_EVENTS})")
def event_sequence(spark, d):
    return _events(spark, d).select("run_id", "sequence", "state", "error_code")


@query(f"WITH {_CURRENT} SELECT run_id, state, updated_at, error_code, sequence FROM c2")
def latest_run_state(spark, d):
    return _current(spark, d).select("run_id", "state", "updated_at", "error_code", "sequence")


@query(f"WITH {_CURRENT} SELECT run_id, attempts FROM c2")
def attempt_counts(spark, d):
    return _current(spark, d).select("run_id", "attempts")


_RETRY = "(error_code IN ('JOB_LOST','MODEL_UNAVAILABLE') OR (source='manual' AND error_code IN ('AGENT_EXECUTION_FAILED','RESULT_INVALID')))"


@query(f"WITH {_CURRENT} SELECT run_id, state, coalesce(state='failed' AND attempts<40 AND {_RETRY}, false) will_retry FROM c2")
def will_retry(spark, d):
    return runs.public(_current(spark, d), 40).select("run_id", "state", "will_retry")


@query(f"WITH {_CURRENT} SELECT run_id, updated_at FROM c2 WHERE state='failed' AND attempts<40 AND {_RETRY} ORDER BY updated_at DESC, run_id DESC LIMIT 5")
def retryable_newest(spark, d):
    """The batch size is the feature."""
    return runs.reconcile(_current(spark, d), 5, True, 40).select("run_id", "updated_at")


@query(f"WITH {_CURRENT} SELECT run_id, updated_at FROM c2 WHERE state='failed' AND attempts<40 AND error_code IN ('JOB_LOST','MODEL_UNAVAILABLE') ORDER BY updated_at, run_id LIMIT 5")
def retryable_oldest(spark, d):
    return runs.reconcile(_current(spark, d), 5, False, 40).select("run_id", "updated_at")


@query(f"WITH {_CURRENT} SELECT run_id, CASE WHEN state='running' AND run_id%4=0 THEN 'failed' WHEN state IN ('preparing','running') THEN 'failed' ELSE state END state, CASE WHEN state IN ('preparing','running') THEN 'JOB_LOST' ELSE error_code END error_code FROM c2")
def recovered_runs(spark, d):
    c = _current(spark, d)
    return runs.recover(c, c.filter("run_id % 4 = 0").select("run_id"))


@query("SELECT c_nationkey submission_id, arg_max(c_custkey, (c_mktsegment, c_custkey)) run_id FROM customer GROUP BY 1")
def latest_run_per_submission(spark, d):
    c = t(spark, d, "customer").select(F.col("c_nationkey").alias("submission_id"), F.col("c_mktsegment").alias("created_at"), F.col("c_custkey").alias("run_id"))
    return runs.latest_by_submission(c).select("submission_id", "run_id")


@query("SELECT user_id%50 submission_id, arg_max(event_id, (ts, event_id)) review_key FROM events GROUP BY 1")
def latest_report(spark, d):
    r = t(spark, d, "events").select((F.col("user_id") % 50).alias("submission_id"), F.col("ts").alias("completed_at"), F.col("event_id").alias("review_key"))
    return reports.latest(r, "submission_id").select("submission_id", "review_key")


@query("SELECT user_id%50 submission_id, event_id%7 counterpart_id, arg_max(event_id, (ts, event_id)) review_key FROM events GROUP BY 1, 2")
def latest_report_per_pair(spark, d):
    r = t(spark, d, "events").select((F.col("user_id") % 50).alias("submission_id"), (F.col("event_id") % 7).alias("counterpart_id"), F.col("ts").alias("completed_at"), F.col("event_id").alias("review_key"))
    return reports.latest(r, "submission_id", "counterpart_id").select("submission_id", "counterpart_id", "review_key")


@query("SELECT l_orderkey*10+l_linenumber AS k, s.a submission_id, s.b counterpart_id, s.p submission_path, s.q counterpart_path FROM lineitem, LATERAL (VALUES (l_partkey, l_suppkey, l_returnflag, l_linestatus), (l_suppkey, l_partkey, l_linestatus, l_returnflag)) s(a, b, p, q)")
def pair_orientation(spark, d):
    item = t(spark, d, "lineitem")
    pairs = item.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("k"), F.col("l_partkey").alias("first_id"), F.col("l_suppkey").alias("second_id"), F.array(F.struct(F.col("l_returnflag").alias("first_path"), F.col("l_linestatus").alias("second_path"), F.lit("d").alias("description"))).alias("evidence"))
    return reports.both_sides(pairs).select("k", "submission_id", "counterpart_id", F.col("evidence")[0]["submission_path"].alias("submission_path"), F.col("evidence")[0]["counterpart_path"].alias("counterpart_path"))


_DECIDED = "SELECT doc_id, CASE WHEN toxic=1 THEN 'violation' WHEN quality=1 THEN 'compliant' ELSE 'inconclusive' END decision, doc_id%100/100.0 confidence FROM labels"


def _decided(spark, d):
    return t(spark, d, "labels").select("doc_id", F.when(F.col("toxic") == 1, "violation").when(F.col("quality") == 1, "compliant").otherwise("inconclusive").alias("decision"), ((F.col("doc_id") % 100) / 100.0).alias("confidence"))


@query(f"SELECT doc_id, decision, CASE WHEN decision='inconclusive' THEN 'inconclusive' ELSE 'completed' END state, CASE decision WHEN 'compliant' THEN true WHEN 'violation' THEN false END compliant FROM ({_DECIDED})")
def report_states(spark, d):
    return _decided(spark, d).select("doc_id", "decision", reports.state(F.col("decision"), F.lit(True)).alias("state"), reports.compliant(F.col("decision")).alias("compliant"))


@query(f"SELECT doc_id id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM ({_DECIDED}) WHERE decision='compliant' AND doc_id%5<>0 AND doc_id%3<2)")
def pending_reviews(spark, d):
    r = _decided(spark, d).select(F.col("doc_id").alias("submission_id"), "decision", F.lit("completed").alias("state"), F.when(F.col("doc_id") % 5 == 0, "p0").otherwise("p1").alias("prompt_version"), F.format_string("m%d", F.col("doc_id") % 3).alias("model"))
    return reports.pending(t(spark, d, "documents").select(F.col("doc_id").alias("id")), r, {"prompt_version": "p1"}, ["m0", "m1"])


@query(f"WITH c AS (SELECT count(*) n FROM documents), p AS (SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM ({_DECIDED}) WHERE decision='compliant')) SELECT c.n candidate_count, c.n-(SELECT count(*) FROM p) skipped_count, (SELECT count(*) FROM p WHERE doc_id%9<>0) reviewed_count, (SELECT count(*) FROM p WHERE doc_id%9=0) failed_count FROM c")
def nightly_summary(spark, d):
    docs = t(spark, d, "documents").select(F.col("doc_id").alias("id"))
    r = _decided(spark, d).select(F.col("doc_id").alias("submission_id"), "decision", F.lit("completed").alias("state"), F.lit("m").alias("model"))
    todo = reports.pending(docs, r, {}, ["m"])
    return reports.skip_summary(docs, todo, docs.filter("id % 9 = 0").withColumn("error", F.lit("x"))).drop("failed_ids")


@query(f"SELECT d.doc_id task_key, l.decision stored_decision, l.decision IS NOT NULL cache_hit FROM documents d LEFT JOIN (SELECT * FROM ({_DECIDED}) WHERE decision='compliant') l ON l.doc_id=d.doc_id")
def ledger_lookup(spark, d):
    tasks = t(spark, d, "documents").select(F.col("doc_id").alias("task_key"), F.col("doc_id").alias("review_key"))
    return reports.with_ledger(tasks, _decided(spark, d).withColumnRenamed("doc_id", "review_key"), "compliance").select("task_key", "stored_decision", "cache_hit")


@query(f"WITH r AS (SELECT d.doc_id, coalesce(l.decision='compliant', false) hit, l.decision, CASE WHEN l.decision IS NULL THEN 'x' END error FROM documents d LEFT JOIN ({_DECIDED}) l ON l.doc_id=d.doc_id) SELECT count(*) tasks, count(*) FILTER (WHERE hit) cache_hits, count(*) FILTER (WHERE NOT hit AND error IS NULL) model_calls, count(*) FILTER (WHERE error IS NULL AND decision<>'inconclusive') completed, count(*) FILTER (WHERE error IS NULL AND decision='inconclusive') inconclusive, count(error) failed FROM r")
def run_summary(spark, d):
    r = t(spark, d, "documents").select("doc_id").join(_decided(spark, d), "doc_id", "left")
    return reports.run_summary(r.select(F.coalesce(F.col("decision") == "compliant", F.lit(False)).alias("cache_hit"), "decision", F.when(F.col("decision").isNull(), "x").alias("error")))


@query("SELECT i AS ord, s_suppkey submission_id, s_acctbal FROM (SELECT row_number() OVER (ORDER BY p_partkey DESC) i, p_partkey FROM part) JOIN supplier ON s_suppkey=p_partkey")
def requested_in_order(spark, d):
    ids = t(spark, d, "part").select(F.col("p_partkey").alias("submission_id"), F.col("p_size").alias("g"))
    # The order asked for: descending ids, numbered without a global window.
    n = ids.agg(F.max("submission_id").alias("m"))
    asked = ids.join(F.broadcast(n)).select("submission_id", (F.col("m") - F.col("submission_id") + 1).alias("ord"))  # n is one row
    return reports.requested(asked, t(spark, d, "supplier").select(F.col("s_suppkey").alias("submission_id"), "s_acctbal")).select("ord", "submission_id", "s_acctbal")


@query("SELECT coalesce(a.s_suppkey, b.c_custkey) submission_id, CASE WHEN a.s_suppkey IS NOT NULL THEN 'agent' ELSE 'stored' END origin, coalesce(a.s_name, b.c_name) AS name FROM supplier a FULL JOIN customer b ON a.s_suppkey=b.c_custkey")
def report_fallback(spark, d):
    a = t(spark, d, "supplier").select(F.col("s_suppkey").alias("submission_id"), F.col("s_name").alias("name"))
    return reports.preferred(a, t(spark, d, "customer").select(F.col("c_custkey").alias("submission_id"), F.col("c_name").alias("name")))


@query(f"WITH v AS (SELECT d.source AS task, l.decision, l.confidence, d.doc_id FROM ({_DECIDED}) l JOIN documents d ON d.doc_id=l.doc_id), n AS (SELECT source AS task, count(*) k FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) OR source='src3' GROUP BY 1) SELECT v.task, CASE WHEN bool_or(decision='inconclusive') OR count(*)<>max(k) THEN 'inconclusive' WHEN bool_or(decision='violation') THEN 'violation' ELSE 'compliant' END decision, min(confidence) confidence, count(*) completed, count(DISTINCT CASE WHEN decision='violation' THEN doc_id%4 END) n_violations FROM v JOIN n ON n.task=v.task GROUP BY 1")
def merge_verdicts(spark, d):
    docs = t(spark, d, "documents").select("doc_id", F.col("source").alias("task"))
    v = _decided(spark, d).join(docs, "doc_id")
    expected = docs.join(t(spark, d, "labels").select("doc_id", F.lit(1).alias("_l")), "doc_id", "left").filter("_l = 1 or task = 'src3'").groupBy("task").agg(F.count("*").alias("chunk_count"))
    none = F.array().cast("array<bigint>")
    v = v.join(expected, "task").withColumn("violations", F.when(F.col("decision") == "violation", F.array(F.col("doc_id") % 4)).otherwise(none)).withColumnRenamed("doc_id", "chunk_index")
    return verdicts.merge(v, "task").select("task", "decision", "confidence", "completed", F.size("violations").cast("long").alias("n_violations"))


@query(f"SELECT doc_id, CASE WHEN decision='violation' AND doc_id%2=0 THEN 'a violation is decided but none is listed' WHEN doc_id%7=0 AND decision<>'inconclusive' THEN 'a cut bundle allows no conclusion' END error FROM ({_DECIDED})")
def compliance_validation(spark, d):
    v = F.from_json(F.when((F.col("decision") == "violation") & (F.col("doc_id") % 2 == 1), F.lit('[{"category":"constraint_violation","summary":"s","evidence":[{"path":"p","description":"d"}]}]')).otherwise(F.lit("[]")), verdicts.VIOLATIONS)
    rows = _decided(spark, d).select("*", v.alias("violations"), F.lit("s").alias("summary"), F.lit(True).alias("requires_human_review"), (F.col("doc_id") % 7 == 0).alias("incomplete"))
    return rows.select("doc_id", verdicts.compliance_error().alias("error"))


_NEAR = "CASE WHEN dx=dy THEN 'exact' WHEN jaccard>=0.95 THEN 'near_identical' ELSE 'minor_edit' END"


@query(f"SELECT lab_id, first_id, second_id, CASE WHEN signal='exact_submission' THEN 'exact' WHEN jaccard>=0.95 THEN 'near_identical' ELSE 'minor_edit' END AS relationship FROM ({_CANDIDATES})")
def program_relationship(spark, d):
    return similarity.detect(held_files(spark, d)).select("lab_id", "first_id", "second_id", verdicts.relationship(F.col("signal"), F.col("jaccard")).alias("relationship"))


@query(f"SELECT first_id, second_id, CASE WHEN rel<>'near_identical' THEN 'the relationship is not the computed one' WHEN first_id%2=0 THEN 'plagiarism is decided without evidence' END error FROM (SELECT *, CASE WHEN signal='exact_submission' THEN 'exact' WHEN jaccard>=0.95 THEN 'near_identical' ELSE 'minor_edit' END rel FROM ({_CANDIDATES}))")
def pair_validation(spark, d):
    e = F.from_json(F.when(F.col("first_id") % 2 == 1, '[{"first_path":"a","second_path":"b","description":"c"}]').otherwise("[]"), "array<struct<first_path: string, second_path: string, description: string>>")
    c = similarity.detect(held_files(spark, d)).select("*", F.lit("plagiarism").alias("decision"), F.lit("near_identical").alias("relationship"), F.lit(0.5).alias("confidence"), F.lit("s").alias("summary"), F.lit(True).alias("requires_human_review"), e.alias("evidence"))
    return c.select("first_id", "second_id", verdicts.pair_error().alias("error"))


@query("SELECT sha256(least(l_partkey, l_suppkey)||chr(0)||greatest(l_partkey, l_suppkey)||chr(0)||'v1') task_key, count(*) n FROM lineitem GROUP BY 1")
def pair_task_keys(spark, d):
    return t(spark, d, "lineitem").groupBy(reports.pair_task_key(F.col("l_partkey"), F.col("l_suppkey"), F.lit("v1")).alias("task_key")).agg(F.count("*").alias("n"))


# --- scope -----------------------------------------------------------------------------------------------------------

# Every lineitem row is an edge between parts; equal ones fall together, so a part has at most one for each line number.
_EDGES = "SELECT DISTINCT l_partkey src, (l_partkey*7+l_linenumber)%(SELECT count(*) FROM part)+1 dst FROM lineitem"


@query(f"""
WITH RECURSIVE e AS ({_EDGES}),
c(node) AS (SELECT p_partkey FROM part WHERE p_partkey<=2 UNION SELECT e.dst FROM c JOIN e ON e.src=c.node)
SELECT node FROM c""")
def include_closure(spark, d):
    parts = t(spark, d, "part")
    n = parts.agg(F.count("*").alias("n"))
    item = t(spark, d, "lineitem").join(F.broadcast(n))  # n is one row
    edges = item.select(F.col("l_partkey").alias("src"), ((F.col("l_partkey") * 7 + F.col("l_linenumber")) % F.col("n") + 1).alias("dst")).distinct()
    return scope.closure(edges, parts.filter("p_partkey <= 2").select(F.col("p_partkey").alias("node")))


def _page_code(spark, d):
    """Pages as C files: each link is an include line."""
    links = F.regexp_replace("html", '<a href="/([^"]+)"', '\n#include "$1.h"\n')
    return t(spark, d, "pages").select("page_id", (F.col("page_id") % 5).alias("submission_id"), F.format_string("src/p%d.c", "page_id").alias("path"), F.coalesce(links, F.lit("")).alias("content"))


def _page_bundles(spark, d):
    """Five bundles: a code file a page, a header for each page's first link, and a script that builds some of them."""
    code = _page_code(spark, d)
    first = F.get(T.includes(F.col("content")), F.lit(0))
    headers = code.select("submission_id", F.concat(F.lit("src/"), first).alias("path"), F.lit("").alias("content")).filter("path is not null").distinct()
    script = code.select("submission_id", F.lit("compile.sh").alias("path"), F.lit("gcc src/p1*.c").alias("content")).distinct()
    return code.drop("page_id").unionByName(headers).unionByName(script).withColumn("truncated", F.lit(False))


_LINKS = """
l AS (SELECT page_id, page_id%5 submission_id, 'src/p'||page_id||'.c' src, regexp_extract_all(coalesce(html, ''), '<a href="/([^"]+)"', 1) w FROM pages),
h AS (SELECT DISTINCT submission_id, 'src/'||w[1]||'.h' dst FROM l WHERE len(w)>0),
e AS (SELECT DISTINCT submission_id, src, dst FROM (SELECT submission_id, src, 'src/'||unnest(w)||'.h' dst FROM l) JOIN h USING (submission_id, dst))"""


@query(f"WITH {_LINKS} SELECT page_id, len(w)::BIGINT n_links FROM l")
def extract_links(spark, d):
    return _page_code(spark, d).select("page_id", F.size(T.includes(F.col("content"))).cast("long").alias("n_links"))


@query(f"WITH {_LINKS} SELECT submission_id, src, dst FROM e")
def include_edges(spark, d):
    return scope.include_edges(_page_bundles(spark, d))


@query(f"""
WITH {_LINKS},
r AS (SELECT submission_id, src path, 'matched_build_glob:src/p1*.c' reason FROM l WHERE src LIKE 'src/p1%'
  UNION ALL SELECT submission_id, src, 'referenced_by_build_definition' FROM l WHERE page_id=1
  UNION ALL SELECT e.submission_id, e.dst, 'included_by:'||e.src FROM e WHERE e.src LIKE 'src/p1%'
  UNION ALL SELECT DISTINCT submission_id, 'compile.sh', 'mandatory_execution_file' FROM l)
SELECT submission_id, path, list_sort(list_distinct(list(reason))) reasons FROM r GROUP BY 1, 2""")
def scope_reasons(spark, d):
    return scope.scope_reasons(_page_bundles(spark, d))


@query("""
SELECT doc_id, len(list_distinct(regexp_extract_all(' '||coalesce(text, ''),
    '(?:^|[^\\p{L}\\p{N}_])([A-Za-z_][\\p{L}\\p{N}_]*)', 1))) n
FROM documents""")
def identifier_counts(spark, d):
    docs = t(spark, d, "documents")
    return docs.select("doc_id", F.size(T.identifiers(F.coalesce("text", F.lit("")))).cast("long").alias("n"))


_MATCH = "WITH f AS (SELECT s_nationkey submission_id, s_suppkey path, s_suppkey%2 content, s_suppkey declared_bytes FROM supplier), r AS (SELECT c_nationkey%3 revision, c_custkey path, c_custkey%4 content FROM customer), m AS (SELECT submission_id, revision, count(*) FILTER (WHERE f.content=r.content) exact_file_count, coalesce(sum(declared_bytes) FILTER (WHERE f.content=r.content), 0)::BIGINT exact_bytes, count(*) comparable_file_count, sum(declared_bytes)::BIGINT comparable_bytes FROM f JOIN r USING (path) GROUP BY 1, 2), n AS (SELECT submission_id, count(*) k FROM f GROUP BY 1)"


def _matches(spark, d):
    f = t(spark, d, "supplier").select(F.col("s_nationkey").alias("submission_id"), F.col("s_suppkey").alias("path"), (F.col("s_suppkey") % 2).cast("string").alias("content"), F.col("s_suppkey").alias("declared_bytes"))
    r = t(spark, d, "customer").select((F.col("c_nationkey") % 3).alias("revision"), F.col("c_custkey").alias("path"), (F.col("c_custkey") % 4).cast("string").alias("content"))
    return scope.reference_match(f, r)


@query(f"{_MATCH} SELECT m.*, exact_file_count/k::DOUBLE exact_ratio FROM m JOIN n USING (submission_id)")
def reference_match(spark, d):
    return _matches(spark, d).withColumn("revision", F.col("revision"))


@query(f"{_MATCH} SELECT submission_id, revision, exact_bytes, exact_file_count FROM (SELECT m.*, exact_file_count/k::DOUBLE q, row_number() OVER (PARTITION BY submission_id ORDER BY exact_bytes DESC, exact_file_count DESC, revision DESC) o FROM m JOIN n USING (submission_id)) WHERE o=1 AND exact_file_count>=1 AND exact_bytes>=5 AND q>=0.1")
def best_reference(spark, d):
    m = _matches(spark, d).withColumn("ord", F.col("revision"))
    return scope.best_reference(m, m.limit(0), 1, 5, 0.1).select("submission_id", "revision", "exact_bytes", "exact_file_count")


_NAMES = tuple(f"Supplier#{i:09d}" for i in range(11))  # a stand-in for the fixed list of critical macros


@query(f"WITH s AS (SELECT s_nationkey submission_id, s_name AS name, (s_suppkey%3)::VARCHAR v FROM supplier), c AS (SELECT s_name AS name, (s_suppkey%2)::VARCHAR v FROM supplier WHERE s_suppkey%5<>0 AND s_name IN {_NAMES}), i AS (SELECT DISTINCT submission_id FROM s), x AS (SELECT i.submission_id, c.name, c.v FROM i, c), w AS (SELECT * FROM s WHERE name IN {_NAMES}) SELECT coalesce(w.submission_id, x.submission_id) submission_id, coalesce(w.name, x.name) AS name, w.v submission, x.v course, w.v IS NOT DISTINCT FROM x.v matches_course FROM w FULL JOIN x ON w.submission_id=x.submission_id AND w.name=x.name")
def macro_compare(spark, d):
    s = t(spark, d, "supplier")
    sub = s.select(F.col("s_nationkey").alias("submission_id"), F.col("s_name").alias("name"), (F.col("s_suppkey") % 3).cast("string").alias("value"))
    course = s.filter("s_suppkey % 5 <> 0").select(F.col("s_name").alias("name"), (F.col("s_suppkey") % 2).cast("string").alias("value"))
    return scope.compare_macros(sub, course, _NAMES)


@query("SELECT s_suppkey path, CASE WHEN s_suppkey%10=0 THEN 'judge_reads_only_mpi_omp_literals' ELSE 'outside_static_build_include_runtime_closure' END reason FROM supplier WHERE s_suppkey%10=0 OR s_suppkey%3<>0")
def excluded_files(spark, d):
    s = t(spark, d, "supplier").select(F.lit(1).alias("submission_id"), F.col("s_suppkey").alias("n"), F.when(F.col("s_suppkey") % 10 == 0, scope.INPUT_FILE).otherwise(F.col("s_suppkey").cast("string")).alias("path"))
    files = s.filter("n % 10 <> 0").unionByName(s.filter("n % 10 = 0"))
    inside = files.filter("n % 3 = 0 and n % 10 <> 0").select("submission_id", "path")
    return scope.excluded(files, inside).select(F.col("n").alias("path"), "reason")


@query("SELECT p_brand AS revision, p_size::VARCHAR AS name FROM part GROUP BY 1, 2 HAVING count(*)=1")
def unambiguous_names(spark, d):
    p = t(spark, d, "part").select(F.col("p_brand").alias("revision"), F.concat_ws("/", "p_name", F.col("p_size").cast("string")).alias("path"), F.col("p_type").alias("content"))
    return scope.unambiguous(p).select("revision", "name")


@query("SELECT p_partkey path, CASE WHEN p_size<=10 OR (p_size>30 AND p_partkey%2=1) THEN 'course' ELSE 'public_origin' END kind FROM part WHERE p_size<=10 OR p_partkey%2=0 OR p_size>30")
def baseline_selection(spark, d):
    p = t(spark, d, "part").select(F.lit(1).alias("submission_id"), "p_partkey", "p_size", F.concat(F.when(F.col("p_size") <= 10, "").otherwise("src/"), F.col("p_partkey").cast("string")).alias("path"))
    course = p.filter("p_size <= 10 or p_size > 30").select("path", F.lit("c").alias("revision"))
    public = p.filter("p_partkey % 2 = 0").select("submission_id", "path", F.lit("p").alias("revision"))
    chosen = scope.select_baseline(p.filter("p_size <= 10 or p_partkey % 2 = 0 or p_size > 30").select("submission_id", "path"), course, public)
    return chosen.select(F.regexp_replace("path", "^src/", "").cast("long").alias("path"), "kind")


# --- workspace tools -------------------------------------------------------------------------------------------------

_WLINES = "SELECT doc_id, unnest(range(1, len(l)+1))::INT line, unnest(l) AS text FROM (SELECT doc_id, string_split(regexp_replace(replace(replace(text, chr(13)||chr(10), chr(10)), chr(13), chr(10)), '\\n\\z', ''), chr(10)) l FROM documents WHERE text<>'')"


def _work(spark, d):
    return t(spark, d, "documents").select("doc_id", F.col("lang").alias("root"), F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 3 == 0, ".TXT").when(F.col("doc_id") % 3 == 1, ".c").otherwise("")).alias("path"), F.coalesce("text", F.lit("")).alias("content"))


@query(f"SELECT doc_id, line, text[1:1000] AS text FROM ({_WLINES}) WHERE contains(text, 'License')")
def search_lines(spark, d):
    return workspace.search(_work(spark, d), "License", "doc_id")


@query(f"SELECT doc_id, line, text[1:1000] AS text FROM ({_WLINES}) WHERE contains(lower(text), 'idiot')")
def search_lines_any_case(spark, d):
    return workspace.search(_work(spark, d), "IDIOT", "doc_id", case_sensitive=False)


@query(f"SELECT doc_id, line, text FROM ({_WLINES}) WHERE line BETWEEN 3 AND 402")
def line_window(spark, d):
    return workspace.read_lines(_work(spark, d), 3, 5000, "doc_id")


@query("SELECT lang root, count(*) file_count, sum(strlen(coalesce(text, '')))::BIGINT total_bytes, count(*) FILTER (WHERE doc_id%3=0) txt, count(*) FILTER (WHERE doc_id%3=1) c, count(*) FILTER (WHERE doc_id%3=2) AS none FROM documents GROUP BY 1")
def inventory(spark, d):
    at = lambda k: F.coalesce(F.try_element_at("suffixes", F.lit(k)), F.lit(0)).cast("long")
    return workspace.inventory(_work(spark, d)).select("root", "file_count", "total_bytes", at(".txt").alias("txt"), at(".c").alias("c"), at("<none>").alias("none"))


@query("""
SELECT doc_id, strlen(x)::BIGINT bytes, sha256(x) sha256, contains(x, chr(0)) AS binary,
    (length(x)-length(replace(x, chr(10), ''))+CASE WHEN x<>'' AND x NOT LIKE '%'||chr(10) THEN 1 ELSE 0 END)::BIGINT lines
FROM (SELECT doc_id, coalesce(text, '') x FROM documents)""")
def file_info(spark, d):
    """A null text is an empty file."""
    return workspace.file_info(_work(spark, d), "doc_id")


@query("SELECT source AS path, 'directory' AS type, 1 AS depth FROM documents GROUP BY 1 UNION ALL SELECT source||'/'||doc_id||CASE doc_id%3 WHEN 0 THEN '.TXT' WHEN 1 THEN '.c' ELSE '' END, 'file', 2 FROM documents")
def tree_listing(spark, d):
    return workspace.tree(_work(spark, d), 2)


@query("SELECT doc_id, CASE WHEN doc_id%5=0 THEN 'evidence line range is invalid' WHEN doc_id%7+1>n THEN 'evidence line exceeds file line count' END error FROM (SELECT doc_id, length(text)-length(replace(text, chr(10), ''))+CASE WHEN text<>'' AND text NOT LIKE '%'||chr(10) THEN 1 ELSE 0 END n FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents))")
def evidence_bounds(spark, d):
    w = _work(spark, d)
    e = w.select("doc_id", "root", "path", F.when(F.col("doc_id") % 5 == 0, 0).otherwise(1).alias("start_line"), (F.col("doc_id") % 7 + 1).alias("end_line"))
    return workspace.check_evidence(e, w).select("doc_id", "error")


@query("SELECT conv_id, count(*) calls, count(DISTINCT turn) turns, count(DISTINCT md5(coalesce(text, ''))) paths, sum(strlen(coalesce(text, '')))::BIGINT bytes, count(*) FILTER (WHERE role='user') user_calls FROM conversations GROUP BY 1")
def tool_trace(spark, d):
    c = t(spark, d, "conversations").select("conv_id", "turn", F.col("role").alias("tool"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("path"), F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("bytes"))
    return workspace.tool_trace(c, "conv_id").select("conv_id", "calls", "turns", "paths", "bytes", F.coalesce(F.try_element_at("by_tool", F.lit("user")), F.lit(0)).cast("long").alias("user_calls"))


@query("SELECT p_partkey, p_name, CASE WHEN (SELECT count(*) FROM part)>80 THEN 80 END next_cursor FROM part ORDER BY p_partkey LIMIT 40 OFFSET 40")
def result_page(spark, d):
    """The page is the feature."""
    return workspace.page(t(spark, d, "part").select("p_partkey", "p_name"), ["p_partkey"], 40, 40)


@query()
def unified_diffs(spark, d):
    files = delta.against_baseline(_doc_files(spark, d), _baseline(spark, d))
    return workspace.compare_files(files).select("submission_id", "diff", "next_cursor")


# --- evidence --------------------------------------------------------------------------------------------------------


@query("SELECT doc_id, text[1:300] AS text, length(text)>300 AS truncated, length(text)::BIGINT original_chars, least(length(text), 300)::BIGINT included_chars, CASE WHEN length(text)>300 THEN 'budget' END truncation_reason, sha256(text) sha256 FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)")
def bounded_text(spark, d):
    return t(spark, d, "documents").select("doc_id", T.bounded(F.coalesce("text", F.lit("")), 300, "budget").alias("_b")).select("doc_id", "_b.*")


@query("SELECT p_partkey, CASE p_size%5 WHEN 0 THEN 4 WHEN 1 THEN 1 ELSE 2 END priority, CASE p_size%5 WHEN 1 THEN 'bak' END artifact FROM part")
def evidence_priority(spark, d):
    path = F.concat(F.lit("a/b/"), F.when(F.col("p_size") % 5 == 0, "run.sh").when(F.col("p_size") % 5 == 1, "run.sh.bak").otherwise("x.c"))
    return t(spark, d, "part").select("p_partkey", T.evidence_priority(path).alias("priority"), T.artifact_kind(path).alias("artifact"))


_TURNS = "f AS (SELECT conv_id submission_id, printf('%05d.txt', turn) path, strlen(coalesce(text, ''))::BIGINT size FROM conversations)"


@query(f"""
WITH RECURSIVE {_TURNS},
n AS (SELECT *, row_number() OVER (PARTITION BY submission_id ORDER BY path) i FROM f),
c AS (SELECT submission_id, path, i, size used, 0 AS chunk FROM n WHERE i=1
  UNION ALL SELECT n.submission_id, n.path, n.i, CASE WHEN used+size>1500 THEN size ELSE used+size END, chunk+CASE WHEN used+size>1500 THEN 1 ELSE 0 END
  FROM c JOIN n ON n.submission_id=c.submission_id AND n.i=c.i+1)
SELECT submission_id, path, chunk FROM c""")
def chunk_packing(spark, d):
    return evidence.pack(_files(spark, d), "submission_id", ["path"], "size", 1500).select("submission_id", "path", "chunk")


@query(f"""
WITH {_TURNS},
a AS (SELECT *, least(size, greatest(1, (4000*greatest(size, 1))//sum(2*greatest(size, 1)) OVER (PARTITION BY submission_id)))::BIGINT o FROM f),
l AS (SELECT *, 2000-sum(o) OVER (PARTITION BY submission_id) spare FROM a),
r AS (SELECT submission_id, path, spare, row_number() OVER (PARTITION BY submission_id ORDER BY turn, size DESC, path) k
  FROM (SELECT *, unnest(range(1, size-o+1)) AS turn FROM l))
SELECT submission_id, path, size, 2::INT priority, o+(SELECT count(*) FROM r WHERE r.submission_id=l.submission_id AND r.path=l.path AND k<=r.spare) budget FROM l""")
def budget_allocation(spark, d):
    return evidence.budgets(_files(spark, d).select("submission_id", "path", "size", F.lit(2).alias("priority")), "submission_id", 2000)


@query()
def split_parts(spark, d):
    return t(spark, d, "documents").select("doc_id", F.explode(evidence.split(1000)("text")).alias("_p")).select("doc_id", "_p.*")


@query("""
WITH c AS (SELECT click_id, CASE WHEN json_valid(props) THEN props::JSON END j FROM clicks WHERE click_id IS NOT NULL),
e AS (SELECT click_id, fullkey, len(regexp_extract_all(fullkey, '[.]|[[]')) depth, key='qty' AND TRY_CAST(value::VARCHAR AS BIGINT)>5 cut FROM c, json_tree(j) WHERE fullkey<>'$')
SELECT click_id, count(fullkey) entries, coalesce(max(depth), 0)::INT depth, max(fullkey) last_path, coalesce(bool_or(cut), false) truncated FROM (SELECT DISTINCT click_id FROM c) LEFT JOIN e USING (click_id) GROUP BY 1""")
def nested_values(spark, d):
    """Every value in what a click says, at whatever depth, and whether a count in it is over five."""
    c = t(spark, d, "clicks").filter("click_id is not null").select("click_id", F.try_parse_json("props").alias("v"))
    every = nested.entries(c, "v", "click_id")
    said = (F.col("name") == "qty") & (F.try_variant_get("value", "$", "bigint") > 5)
    some = every.groupBy("click_id").agg(F.count("*").alias("entries"), F.max("depth").alias("depth"), F.max("path").alias("last_path"), F.bool_or(F.coalesce(said, F.lit(False))).alias("truncated"))
    return c.select("click_id").distinct().join(some, "click_id", "left").fillna({"entries": 0, "depth": 0, "truncated": False})


@query("""
WITH s AS (SELECT client_id, epoch_us(ts) a, epoch_us(ts)+floor(value)::BIGINT*1000000 b FROM clicks WHERE client_id IS NOT NULL AND ts IS NOT NULL AND isfinite(value) AND floor(value)>0),
o AS (SELECT *, max(b) OVER (PARTITION BY client_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) m FROM s),
g AS (SELECT *, sum((m IS NULL OR a>m)::INT) OVER (PARTITION BY client_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) k FROM o),
i AS (SELECT client_id, k, count(*) n, max(b)-min(a) len FROM g GROUP BY 1, 2)
SELECT client_id, sum(n)::BIGINT spans, count(*) stretches, sum(len)::BIGINT covered FROM i GROUP BY 1""")
def covered_time(spark, d):
    """How long each client was busy, if a click takes as many seconds as its value says: stretches of clicks that overlap."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    seconds = F.floor("value").cast("long")
    c = t(spark, d, "clicks").filter("client_id is not null and ts is not null and not isnan(value)").select("client_id", at.alias("start"), (at + seconds * 1_000_000).alias("end"))
    return evidence.coverage(c, "client_id")


@query("SELECT user_id%50 submission_id, event_id%7 counterpart_id, arg_max(event_id, (ts, event_id)) review_key FROM events GROUP BY 1, 2")
def latest_index_stream(spark, d):
    """The latest report of each pair, as a stream of all events keeps it, a batch at a time."""
    import uuid

    source, out = (adopt(f"{shared_dir(spark)}/{x}-{uuid.uuid4().hex}", spark) for x in ("reports", "latest"))
    r = t(spark, d, "events").select((F.col("user_id") % 50).alias("submission_id"), (F.col("event_id") % 7).alias("counterpart_id"), F.col("ts").alias("completed_at"), F.col("event_id").alias("review_key"))
    r.write.option("maxRecordsPerFile", 50_000).parquet(source)
    stream = spark.readStream.schema(r.schema).option("maxFilesPerTrigger", "4").parquet(source)
    latest.keep_latest(stream, out, ("submission_id", "counterpart_id")).awaitTermination()
    return latest.generation(spark, out, ("submission_id", "counterpart_id")).select("submission_id", "counterpart_id", "review_key")


@query()
def admission_stream(spark, d):
    """A bounded queue for each client over all sales, which are done when they arrive; a test holds queues against plain ones."""
    import uuid

    from .streaming import stateful

    source, spot, out = (adopt(f"{shared_dir(spark)}/{x}-{uuid.uuid4().hex}", spark) for x in ("requests", "spot", "admitted"))
    sales = t(spark, d, "sales").filter("client_id is not null and sale_id is not null")
    each = lambda kind, at: sales.filter(F.col(at).isNotNull()).select(F.col("client_id").cast("string").alias("queue"), F.col("sale_id").cast("string").alias("run_id"), F.lit(kind).alias("kind"), F.unix_micros(F.col(at).cast("timestamp")).alias("at"))
    rows = each("request", "sold_at").unionByName(each("finished", "arrived_at").filter("at is not null"))
    rows.write.parquet(source)
    stream = spark.readStream.schema(rows.schema).parquet(source)
    stateful.start_admission(stream, 2, spot, lambda b, n: b.write.mode("overwrite").parquet(f"{out}/batch={n}")).awaitTermination()
    return spark.read.parquet(f"{out}/batch=*").drop("batch")


@query(f"WITH {_CURRENT} SELECT run_id::VARCHAR run_id, state, error_code, sequence, attempts FROM c2")
def run_state_stream(spark, d):
    """A stream of all events, a batch at a time."""
    import uuid

    source, out = f"{shared_dir(spark)}/events-{uuid.uuid4().hex}", f"{shared_dir(spark)}/states-{uuid.uuid4().hex}"
    _events(spark, d).select(F.col("run_id").cast("string"), "state", F.timestamp_micros("updated_at").alias("updated_at"), "error_code", F.col("sequence").cast("long")).write.parquet(source)
    stream = spark.readStream.schema(spark.read.parquet(source).schema).option("maxFilesPerTrigger", "4").parquet(source)
    run_states.to_table(run_states.run_states(stream), out).awaitTermination()
    return run_states.settled(spark, out).select("run_id", "state", "error_code", "sequence", "attempts")


# --- identities, orders, schemas -------------------------------------------------------------------------------------

_VERSIONS = identity.Versions(rules="r2", prompt="p3", schema="s1", model="m", model_parameters=(("temperature", 0), ("top", 3)))


def _documents_as_tasks(spark, d):
    docs = t(spark, d, "documents")
    digest = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    return docs.select(F.col("doc_id").cast("string").alias("id"), F.col("lang").alias("lab_id"), F.col("source").alias("owner"), digest.alias("input_digest"), digest.alias("delta_digest")).withColumns(
        {"basis_commit": F.lit("c0"), "basis_tree_digest": F.sha2("lab_id", 256), "document_digest": F.lit(None).cast("string"), "lab_definition_digest": F.lit("")}
    )


# Parameters are JSON within JSON, so their quotes are escaped.
_MODEL_PARAMETERS = r'{\"temperature\":0,\"top\":3}'
_TASK_PARAMETERS = r'{\"delta_version\":\"1\",\"max_file_bytes\":100,\"review_strategy\":\"whole\",\"source_policy_version\":\"1\"}'


@query(f"""
SELECT id, sha256('{{"basis_commit":"c0","basis_tree_digest":"'||sha256(lang)||'","document_digest":"","input_digests":["'||g||'"],"lab_definition_digest":"","lab_id":"'||lang
    ||'","model":"m","model_parameters":"{_MODEL_PARAMETERS}","prompt_version":"p3","rules_version":"r2","schema_version":"s1","source_delta_digests":["'||g
    ||'"],"submission_ids":["'||id||'"],"task_parameters":"{_TASK_PARAMETERS}","task_type":"compliance"}}') review_key
FROM (SELECT doc_id::VARCHAR id, lang, sha256(coalesce(text, '')) g FROM documents)""")
def review_identity(spark, d):
    return identity.keyed(_documents_as_tasks(spark, d), identity.single(_VERSIONS, max_file_bytes=100)).select("id", "review_key")


@query("SELECT n_name lab_id, ['basis_commit']||CASE WHEN n_nationkey%3=0 THEN ['basis_tree_digest'] ELSE [] END differs FROM nation WHERE n_nationkey%2=0 UNION ALL SELECT n_name, ['basis_tree_digest'] FROM nation WHERE n_nationkey%2=1 AND n_nationkey%3=0")
def differing_bases(spark, d):
    n = t(spark, d, "nation")
    basis = n.select(F.col("n_name").alias("lab_id"), F.lit("c").alias("basis_commit"), F.lit("t").alias("basis_tree_digest"))
    other = n.select(F.col("n_name").alias("lab_id"), F.when(F.col("n_nationkey") % 2 == 0, "x").otherwise("c").alias("basis_commit"), F.when(F.col("n_nationkey") % 3 == 0, "x").otherwise("t").alias("basis_tree_digest"))
    return identity.differing_bases(basis, other)


@query(f"SELECT id, lab_id, row_number() OVER (PARTITION BY lab_id ORDER BY submitted_at, id) place FROM ({_SUBS})")
def corpus_order(spark, d):
    return similarity.corpus_rank(submissions(spark, d)).select("id", "lab_id", F.col("place").cast("long").alias("place"))


@query(f"WITH v AS ({_EVENTS}) SELECT run_id, sequence, before, state FROM (SELECT *, lag(state) OVER (PARTITION BY run_id ORDER BY sequence) before FROM v) WHERE NOT coalesce((before IS NULL AND state='queued') OR (before='preparing' AND state IN ('running','failed')) OR (before='running' AND state='failed'), false)")
def broken_transitions(spark, d):
    return runs.broken_transitions(_events(spark, d)).select("run_id", "sequence", "before", "state")


@query("""
WITH q AS (SELECT 'review-'||sha256(coalesce(text, '')) run_id, min(turn) AS created FROM conversations WHERE role='user' GROUP BY 1),
n AS (SELECT * FROM q WHERE run_id NOT IN (SELECT 'review-'||sha256(coalesce(text, '')) FROM conversations WHERE role<>'user'))
SELECT run_id, row_number() OVER (ORDER BY created, run_id)<=50 admitted FROM n""")
def admission(spark, d):
    """The room is the feature: fifty are admitted, the others are told so."""
    c = t(spark, d, "conversations").select(F.coalesce("text", F.lit("")).alias("payload"), F.col("role").alias("model"), F.col("turn").alias("created_at"))
    known = c.filter("model <> 'user'").select(F.concat(F.lit("review-"), F.sha2(F.col("payload").cast("binary"), 256)).alias("run_id")).distinct()
    return runs.admit(c, known, ["user"], 50).select("run_id", "admitted")


_PAYLOAD = """{"schema_version":@VERSION@,"audience":"@AUDIENCE@","submission":{"id":"@ID@","owner":"o","lab_id":"l","score":@SCORE@,"input_digest":"@SHA@","submitted_at":"2024-01-01T00:00:00Z",
"input_manifest":{},"lab_definition":{},"active_run":{"id":7,"state":"Success","result_info":{},"score":null,"performance":1.5,"finished_at":"2024-01-01T00:00:00Z"}},
"basis":{"commit":"c","tree_digest":"@SHA@","document_digest":"@SHA@","source_path":"s","document_path":"d","public_references":[{"repository":"r","revision":"v","tree_digest":"@REF@","path_prefix":"p"}]},
"model":"m","source":"@SOURCE@","rules_version":"r","prompt_version":"p","tool_version":"t","result_schema_version":"x","issued_at":"2024-01-01T00:00:00Z","expires_at":"@END@","nonce":"0123456789abcdef"@MORE@}"""


@query("""
SELECT doc_id, CASE doc_id%11 WHEN 9 THEN 'payload.schema_version is not one of 1' WHEN 10 THEN 'payload.audience is not one of checker' WHEN 0 THEN 'payload.submission.id is not uuid' WHEN 1 THEN 'payload.source is not one of manual, nightly' WHEN 2 THEN 'payload has other fields'
    WHEN 3 THEN 'payload.submission.score is not count' WHEN 4 THEN 'it is valid for more than 15 minutes' WHEN 5 THEN 'a nightly payload names another model'
    WHEN 6 THEN 'payload.basis.public_references[].tree_digest is not digest' WHEN 7 THEN 'it is not valid now' END error
FROM labels""")
def payload_errors(spark, d):
    k = F.col("doc_id") % 11
    case = lambda n, bad, good: F.when(k == n, bad).otherwise(good)
    given = {
        "@ID@": case(0, "x", F.format_string("00000000-0000-4000-8000-%012d", "doc_id")), "@SOURCE@": case(5, "nightly", case(1, "weekly", "manual")), "@MORE@": case(2, ',"more":1', ""), "@SCORE@": case(3, "-1", "60"),
        "@END@": case(4, "2024-01-01T00:16:00Z", case(7, "2024-01-01T00:05:00Z", "2024-01-01T00:15:00Z")), "@REF@": case(6, "zz", F.repeat(F.lit("b"), F.lit(64))), "@SHA@": F.repeat(F.lit("a"), F.lit(64)), "@VERSION@": case(9, "2", "1"), "@AUDIENCE@": case(10, "other", "checker"),
    }
    text = F.lit(_PAYLOAD)
    for mark, value in given.items():
        text = F.replace(text, F.lit(mark), value)
    rows = t(spark, d, "labels").select("doc_id", text.alias("text"))
    return envelopes.review_errors(rows, F.lit("2024-01-01 00:10:00").cast("timestamp"), "n", 1, "checker").select("doc_id", "error")


@query("""
SELECT doc_id, CASE WHEN doc_id%2=1 THEN 'human review is not asked for' WHEN quality=1 AND doc_id%3=0 THEN 'a compliant report lists violations' WHEN doc_id%3=1 THEN 'the limitations are not texts in Chinese'
    WHEN doc_id%5=0 THEN 'a violation''s category is unknown' WHEN doc_id%5=1 THEN 'an evidence description is not in Chinese' WHEN doc_id%5=2 THEN 'no such file'
    WHEN doc_id%5=3 THEN 'a violation cites nothing of the submission' END error
FROM (SELECT doc_id, CASE WHEN doc_id%3=0 THEN quality END quality FROM labels)""")
def agent_report_errors(spark, d):
    i = F.col("doc_id")
    han = F.lit("\u8bc1\u636e")
    item = F.struct(F.when(i % 5 == 3, "baseline").otherwise("submission").alias("root"), F.lit("p").alias("path"), F.when(i % 5 == 1, "x").otherwise(han).alias("description"), F.when(i % 5 == 2, "no such file").alias("error"))
    v = F.struct(F.when(i % 5 == 0, "odd").otherwise("constraint_violation").alias("category"), han.alias("summary"), F.array(item).alias("evidence"))
    rows = t(spark, d, "labels").select(
        "doc_id", (i % 2 == 0).alias("requires_human_review"), F.when((F.col("quality") == 1) & (i % 3 == 0), "compliant").otherwise("violation").alias("decision"), F.lit(0.5).alias("confidence"),
        han.alias("summary"), F.array(F.when(i % 3 == 1, "none").otherwise(han)).alias("limitations"), F.array(v).alias("violations"),
    )
    return rows.select("doc_id", verdicts.agent_error().alias("error"))


@query(f"""
WITH s AS (SELECT doc_id, lang, sh, sha256(list_sort(sh)::VARCHAR) g FROM ({_SHINGLES}) WHERE len(sh)>0),
r AS (SELECT lang, g, count(*) members, any_value(sh) sh FROM s GROUP BY 1, 2),
e AS (SELECT lang, g, len(sh) n, hash(unnest(sh)) x FROM r),
p AS (SELECT a.lang, a.g FROM e a JOIN e b ON a.x=b.x AND a.lang=b.lang AND a.g<>b.g GROUP BY a.lang, a.g, b.g, a.n, b.n HAVING count(*)::DOUBLE/(a.n+b.n-count(*))>=0.7),
l AS (SELECT lang, g, count(*) links FROM p GROUP BY 1, 2)
SELECT doc_id id, members, coalesce(links, 0) links FROM s JOIN r USING (lang, g) LEFT JOIN l USING (lang, g)""")
def similarity_classes(spark, d):
    return similarity.classes(held_files(spark, d)).select("id", "members", "links")


@query()
def compliance_payloads(spark, d):
    """Evidence of each document's review as JSON under a budget; a test holds the shares and cuts against plain ones."""
    files, base = _doc_files(spark, d), _baseline(spark, d)
    found = staged(delta.build(files, base), "deltas")
    digests = delta.digests(found, files.select("submission_id", F.lit(False).alias("incomplete")))
    subs = t(spark, d, "documents").select(F.col("doc_id").alias("submission_id"), F.col("source").alias("owner"), F.col("lang").alias("lab_id"), F.lit(60).alias("score"), F.lit("rules").alias("document"), F.lit("{}").alias("definition"))
    bundle = files.select("submission_id", F.lit("run.sh").alias("path"), "content", F.octet_length("content").alias("size"), F.octet_length("content").alias("bytes_read"), "omission_reason")
    return payloads.compliance(subs.join(digests.withColumnRenamed("digest", "delta_digest"), "submission_id"), found, bundle, 4000)
