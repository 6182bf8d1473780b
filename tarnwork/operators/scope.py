"""Execution scope: which files of a bundle a build and run can reach, and what they are compared with."""

from __future__ import annotations

import ast
import fnmatch

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..storage import staged

# Files that always run, compile-time files, and the macros that must agree with the course.
ROOT_FILES = ("CMakeLists.txt", "compile.sh", "run.sh")
CRITICAL_PATHS = ("src/macrodef.h", "src/macrodef.fh")
CRITICAL_MACROS = ("ABEtype", "GAUGE", "SommerType", "Psi4type", "RPS", "AGM", "RPB", "MAPBH", "Cell", "Vertex", "ghost_width")
INPUT_FILE = "AMSS_NCKU_Input.py"
MIN_FILES, MIN_BYTES, MIN_RATIO = 8, 128_000, 0.3


def closure(edges: DataFrame, roots: DataFrame, *scope: str) -> DataFrame:
    """(scope.., node) of all nodes reachable over edges (scope.., src, dst) from roots (scope.., node).

    Breadth first; a node is followed once, so cycles end. Edges are a table of their own, read in each round and made
    once; so is each frontier, and the loop runs as often as the longest shortest path.
    """
    key = [*scope, "node"]
    edges = staged(edges.select(*scope, "src", "dst"), "closure-edges")
    seen = frontier = staged(roots.select(*key).distinct(), "closure")
    while frontier.take(1):
        step = frontier.join(edges.select(*scope, F.col("src").alias("node"), "dst"), key).select(*scope, F.col("dst").alias("node")).distinct()
        frontier = staged(step.join(seen, key, "left_anti"), "closure")
        seen = seen.unionByName(frontier)
    return seen


def include_edges(files: DataFrame) -> DataFrame:
    """submission_id, src, dst: headers that a code file includes, by parent, by root, or by name."""
    code = files.filter(T.suffix(F.col("path")).isin(*T.COMPILED, *T.HEADERS))
    named = code.select("submission_id", F.col("path").alias("src"), F.explode(T.includes(F.col("content"))).alias("target"))
    headers = files.filter(T.suffix(F.col("path")).isin(*T.HEADERS)).select("submission_id", F.col("path").alias("dst"))
    here = F.when(T.parent(F.col("src")) == "", F.col("target")).otherwise(F.concat_ws("/", T.parent(F.col("src")), "target"))
    plain = lambda x: F.regexp_replace(F.regexp_replace(x, r"(^|/)(?:\./)+", "$1"), "//+", "/")
    direct = named.join(headers.withColumnRenamed("dst", "_p"), (named["submission_id"] == headers["submission_id"]) & (plain(here) == F.col("_p"))).select(named["submission_id"], "src", F.col("_p").alias("dst"))
    root = named.withColumn("dst", plain(F.col("target"))).join(headers, ["submission_id", "dst"])
    name = named.withColumn("_n", T.basename(F.col("target"))).join(headers.withColumn("_n", T.basename(F.col("dst"))), ["submission_id", "_n"])
    cols = ["submission_id", "src", "dst"]
    return direct.select(*cols).unionByName(root.select(*cols)).unionByName(name.select(*cols)).distinct()


def glob_hits(path, globs):
    """Those of the globs that a path matches, by fnmatch's rules: an unclosed [ is itself, an empty range meets nothing."""

    @F.pandas_udf("array<string>")
    def run(paths: pd.Series, globs: pd.Series) -> pd.Series:
        return pd.Series([[g for g in some if fnmatch.fnmatchcase(p, g)] for p, some in zip(paths, globs)], dtype=object)

    return run(path, globs)


def scope_reasons(files: DataFrame) -> DataFrame:
    """submission_id, path, reasons: files in the static execution scope. files: submission_id, path, content, truncated."""
    pick = lambda name: F.max(F.when(F.col("path") == name, F.col("content")))
    per = files.groupBy("submission_id").agg(F.coalesce(pick("compile.sh"), F.lit("")).alias("compile"), F.coalesce(pick("run.sh"), F.lit("")).alias("run"), F.bool_or("truncated").alias("cut"))
    per = per.withColumn("tools", T.build_tools(F.col("compile"), F.col("run")))
    all_files = files.join(per, "submission_id")
    name, suffix, path = T.basename(F.col("path")), T.suffix(F.col("path")), F.col("path")
    is_build = (path == "CMakeLists.txt") | (F.col("tools.cmake") & ((name == "CMakeLists.txt") | (suffix == ".cmake"))) | (F.col("tools.make") & (name.isin("CMakeLists.txt", "Makefile", "makefile") | suffix.isin(".mk", ".make")))
    build = all_files.withColumn("is_build", is_build)
    texts = build.filter("is_build").groupBy("submission_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "content"))), lambda f: f["content"]), "\n").alias("_b"))
    build = build.join(texts, "submission_id", "left").withColumn("build_text", F.concat_ws("\n", "compile", "run", F.coalesce("_b", F.lit(""))))
    build = build.withColumn("dynamic", F.col("build_text").rlike(T.DYNAMIC_BUILD))
    compiled, code = suffix.isin(*T.COMPILED), suffix.isin(*T.COMPILED, *T.HEADERS)
    quoted = F.concat(F.lit(r"(?<![A-Za-z0-9_])"), T.literal(T.stem(path)), F.lit(r"(?![A-Za-z0-9_])"))
    mentioned = compiled & (F.contains(F.col("build_text"), path) | F.contains(F.col("build_text"), name) | F.regexp_like(F.col("build_text"), quoted))
    globs = F.array_distinct(F.regexp_extract_all("build_text", F.lit(T.BUILD_GLOB), F.lit(1)))
    # Globs without a set are matched here; those with one, which regexes read otherwise, by the standard library.
    as_regex = lambda g: F.concat(F.lit("(?s)^"), F.replace(F.replace(F.replace(g, F.lit("."), F.lit("[.]")), F.lit("*"), F.lit(".*")), F.lit("?"), F.lit(".")), F.lit("\\z"))
    has_set = lambda g: F.contains(g, F.lit("["))
    plain = F.filter(F.filter(globs, lambda g: ~has_set(g)), lambda g: F.regexp_like(path, as_regex(g)))
    hit = F.concat(plain, glob_hits(path, F.filter(globs, has_set)))
    rules = F.array_compact(F.concat(
        F.array(F.when(path.isin(*ROOT_FILES), F.lit("mandatory_execution_file")), F.when(F.col("is_build"), F.lit("build_definition")), F.when(mentioned, F.lit("referenced_by_build_definition"))),
        F.transform(hit, lambda g: F.concat(F.lit("matched_build_glob:"), g)),
    ))
    first = build.withColumn("reasons", rules)
    none = first.groupBy("submission_id").agg((~F.bool_or(compiled & (F.size("reasons") > 0))).alias("no_source"))
    first = first.join(none, "submission_id")
    fallback = F.when(compiled & F.col("dynamic"), F.array(F.lit("conservative_dynamic_build_fallback"))).when(compiled & F.col("no_source"), F.array(F.lit("conservative_no_static_source_match"))).otherwise(F.array().cast("array<string>"))
    first = first.withColumn("reasons", F.concat("reasons", fallback))
    roots = first.filter((F.size("reasons") > 0) & code).select("submission_id", path.alias("node"))
    edges = include_edges(files)
    reached = closure(edges, roots, "submission_id")
    by_include = edges.join(reached.withColumnRenamed("node", "src"), ["submission_id", "src"]).groupBy("submission_id", F.col("dst").alias("path")).agg(F.collect_set(F.concat(F.lit("included_by:"), "src")).alias("more"))
    second = first.join(by_include, ["submission_id", "path"], "left").withColumn("reasons", F.concat("reasons", F.coalesce("more", F.array().cast("array<string>"))))
    asset = path.startswith("src/")
    outside = (F.size("reasons") == 0) & (path != INPUT_FILE)
    scripts = F.concat_ws("\n", "compile", "run")
    late = F.array_compact(F.array(
        F.when(scripts.rlike(T.SHELL_PATH) & asset & ~code, F.lit("conservative_dynamic_runtime_asset_path")),
        F.when(outside & asset & F.contains(F.concat_ws("\n", scripts, "build_text"), path) & ~(scripts.rlike(T.SHELL_PATH) & ~code), F.lit("literal_runtime_or_build_path")),
        F.when(F.col("cut") & (path != INPUT_FILE), F.lit("conservative_truncated_bundle_fallback")),
    ))
    third = second.withColumn("reasons", F.concat("reasons", late))
    # Scripts that change into src/ reach assets by bare name, from any text in scope.
    moved = F.col("run").rlike(T.ENTER_SOURCES)
    reach = third.filter(moved & (F.size("reasons") > 0)).groupBy("submission_id").agg(F.array_join(F.collect_list("content"), "\n").alias("_reach"))
    last = third.join(reach, "submission_id", "left").withColumn("reasons", F.concat("reasons", F.when(asset & F.coalesce(F.contains("_reach", name), F.lit(False)), F.array(F.lit("runtime_asset_with_src_working_directory"))).otherwise(F.array().cast("array<string>"))))
    return last.filter(F.size("reasons") > 0).select("submission_id", "path", F.array_sort(F.array_distinct("reasons")).alias("reasons"))


def excluded(files: DataFrame, scope: DataFrame) -> DataFrame:
    """Files outside the scope, with why; the input file is outside in any case."""
    out = files.join(scope.select("submission_id", "path", F.lit(True).alias("_in")), ["submission_id", "path"], "left")
    reason = F.when(F.col("path") == INPUT_FILE, "judge_reads_only_mpi_omp_literals").when(F.col("_in").isNull(), "outside_static_build_include_runtime_closure")
    return out.withColumn("reason", reason).filter("reason is not null").drop("_in")


def reference_match(files: DataFrame, references: DataFrame) -> DataFrame:
    """Per (submission_id, revision): files and bytes with the same path, and with the same text up to line ends.

    The ratio is over all eligible files, found in the reference or not.
    """
    digest = lambda x: F.sha2(T.unix_newlines(x).cast("binary"), 256)
    of = files.groupBy("submission_id").agg(F.count("*").alias("_all"))
    met = files.select("submission_id", "path", "declared_bytes", digest(F.col("content")).alias("_a")).join(references.select("revision", "path", digest(F.col("content")).alias("_b")), "path")
    same = F.col("_a") == F.col("_b")
    got = met.groupBy("submission_id", "revision").agg(
        F.count_if(same).alias("exact_file_count"), F.coalesce(F.sum(F.when(same, F.col("declared_bytes"))), F.lit(0)).cast("long").alias("exact_bytes"), F.count("*").alias("comparable_file_count"), F.sum("declared_bytes").cast("long").alias("comparable_bytes")
    )
    return got.join(of, "submission_id").withColumn("exact_ratio", F.col("exact_file_count") / F.col("_all")).drop("_all")


def best_reference(matches: DataFrame, course: DataFrame, files: int = MIN_FILES, size: int = MIN_BYTES, ratio: float = MIN_RATIO) -> DataFrame:
    """The reference with most exact bytes, then files, then the last configured (ord), if it is enough and beats the course."""
    order = F.struct("exact_bytes", "exact_file_count", "ord")
    best = matches.groupBy("submission_id").agg(F.max_by(F.struct("revision", "exact_bytes", "exact_file_count", "exact_ratio"), order).alias("_r")).select("submission_id", "_r.*")
    enough = best.filter((F.col("exact_file_count") >= files) & (F.col("exact_bytes") >= size) & (F.col("exact_ratio") >= ratio))
    c = course.select("submission_id", F.col("exact_bytes").alias("_b"), F.col("exact_file_count").alias("_c"))
    beats = F.struct("exact_bytes", "exact_file_count") > F.struct(F.coalesce("_b", F.lit(0).cast("long")).alias("exact_bytes"), F.coalesce("_c", F.lit(0).cast("long")).alias("exact_file_count"))
    return enough.join(c, "submission_id", "left").filter(beats).drop("_b", "_c")


def unambiguous(files: DataFrame) -> DataFrame:
    """Reference files by base name, where only one of a revision has it."""
    out = files.withColumn("name", T.basename(F.col("path")))
    return out.groupBy("revision", "name").agg(F.count("*").alias("_n"), F.first("path").alias("path"), F.first("content").alias("content")).filter("_n = 1").drop("_n")


def select_baseline(scope: DataFrame, course: DataFrame, public: DataFrame) -> DataFrame:
    """submission_id, path, kind, revision: the course's file at the root and for critical paths, else the public one, else the course's."""
    met = scope.join(course.select("path", F.col("revision").alias("_c")), "path", "left").join(public.select("submission_id", "path", F.col("revision").alias("_p")), ["submission_id", "path"], "left")
    own = F.col("_c").isNotNull() & (~F.col("path").startswith("src/") | F.col("path").isin(*CRITICAL_PATHS))
    kind = F.when(own, "course").when(F.col("_p").isNotNull() & F.col("path").startswith("src/"), "public_origin").when(F.col("_c").isNotNull(), "course")
    return met.withColumn("kind", kind).filter("kind is not null").select("submission_id", "path", "kind", F.when(F.col("kind") == "course", F.col("_c")).otherwise(F.col("_p")).alias("revision"))


def macros(files: DataFrame, *key: str) -> DataFrame:
    """key, name, value of each definition; a later file by path, and a later line, decides."""
    each = files.select(*key, "path", F.posexplode(T.definitions(F.col("content"))).alias("_i", "_d"))
    last = F.max_by(F.struct("_d.value"), F.struct("path", "_i"))
    return each.groupBy(*key, F.col("_d.name").alias("name")).agg(last.alias("_v")).select(*key, "name", F.col("_v.value").alias("value"))


def compare_macros(submission: DataFrame, course: DataFrame, names=CRITICAL_MACROS) -> DataFrame:
    """name, submission, course, matches_course of the listed macros that either defines."""
    a = submission.filter(F.col("name").isin(*names)).select("submission_id", "name", F.col("value").alias("submission"), F.lit(True).alias("_a"))
    # Each submission is met with every listed macro of the course: one array of at most as many entries as names.
    listed = course.filter(F.col("name").isin(*names)).agg(F.collect_list(F.struct("name", F.col("value").alias("course"))).alias("_c"), F.lit(1).alias("_one"))
    ids = submission.select("submission_id").distinct().withColumn("_one", F.lit(1))
    b = ids.join(F.broadcast(listed), "_one").select("submission_id", F.explode("_c").alias("_m")).select("submission_id", "_m.*")
    return a.join(b, ["submission_id", "name"], "full").select("submission_id", "name", "submission", "course", F.col("submission").eqNullSafe(F.col("course")).alias("matches_course"))


PARAMETERS = "struct<mpi: bigint, omp: bigint, admitted_cpu: bigint, valid_product: boolean, error: string>"


def input_parameters(cpu: int, default_mpi: int):
    """UDF of an input file's text: the two integer literals that the judge reads, checked against the track's CPUs."""

    def one(text):
        out = {"mpi": None, "omp": None, "admitted_cpu": cpu, "valid_product": None, "error": None}
        found = {"MPI_processes": default_mpi, "OMP_threads": 1}
        try:
            for node in ast.parse(text or "").body:
                names = [t.id for t in node.targets if isinstance(t, ast.Name) and t.id in found] if isinstance(node, ast.Assign) else []
                for name in names:
                    value = ast.literal_eval(node.value)
                    if type(value) is not int:
                        raise ValueError(f"{name} is not an integer literal")
                    found[name] = value
        except (SyntaxError, ValueError) as e:
            return out | {"error": f"cannot validate input: {e}"}
        mpi, omp = found.values()
        good = min(mpi, omp) >= 1 and max(mpi, omp, mpi * omp) <= cpu
        return out | {"mpi": mpi, "omp": omp, "valid_product": good, "error": None if good else "values exceed the track's CPUs"}

    @F.pandas_udf(PARAMETERS)
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(t) for t in texts], columns=["mpi", "omp", "admitted_cpu", "valid_product", "error"]).astype({"mpi": "Int64", "omp": "Int64", "valid_product": "boolean"})

    return run
