"""Framework detection and the Next.js route model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factgraph.functions import columns as C
from factgraph.functions import fixed


SIGNALS = "framework string, place int, kind string, ord int, signal string"


def _signals(spark) -> DataFrame:
    rows = [(f, i, kind, j, name) for i, (f, (packages, markers)) in enumerate(fixed.FRAMEWORKS.items()) for kind, names in (("package", packages), ("marker", markers)) for j, name in enumerate(names)]
    return F.broadcast(spark.createDataFrame(rows, SIGNALS))


def detect(dependencies: DataFrame, entries: DataFrame, with_package: DataFrame, signals: DataFrame | None = None) -> DataFrame:
    """(project_id, framework, confidence, version, evidence): dependency and marker make it certain, a dependency likely, else possible.

    ``with_package``: projects that have a package.json; without any framework such a project is a Node one.
    ``signals``: another table of SIGNALS, of any size.
    """
    signals = _signals(dependencies.sparkSession) if signals is None else signals
    runtime_first = dependencies.groupBy("project_id", "name").agg(F.min_by("version", F.when(F.col("section") == "dependencies", 0).otherwise(1)).alias("version"))
    hits = runtime_first.join(signals.where("kind = 'package'"), F.col("name") == F.col("signal")).select("project_id", "framework", "kind", "ord", "version", "signal")
    hits = hits.unionByName(entries.join(signals.where("kind = 'marker'"), F.col("entry") == F.col("signal")).select("project_id", "framework", "kind", "ord", F.lit(None).cast("string").alias("version"), "signal"))
    found = hits.groupBy("project_id", "framework").agg(
        F.bool_or(F.col("kind") == "package").alias("dep"),
        F.bool_or(F.col("kind") == "marker").alias("mark"),
        F.count(F.when(F.col("kind") == "marker", 1)).alias("markers"),
        F.min_by("version", F.when(F.col("kind") == "package", F.col("ord"))).alias("version"),
        F.sort_array(F.collect_list(F.struct((F.col("kind") == "marker").alias("later"), "ord", "signal", "version"))).alias("hits"),
    )
    found = found.where("framework <> 'laravel' OR markers = 2")
    confidence = F.when(F.col("dep") & F.col("mark"), "certain").when(F.col("dep"), "likely").otherwise("possible")
    said = F.transform("hits", lambda h: F.when(h["later"], F.concat(F.lit("has "), h["signal"])).otherwise(F.concat(F.lit("depends on "), h["signal"], F.lit(" "), h["version"])))
    known = found.select("project_id", "framework", confidence.alias("confidence"), "version", said.alias("evidence"))
    plain = with_package.select("project_id").distinct().join(known.select("project_id"), "project_id", "left_anti")
    return known.unionByName(plain.select("project_id", F.lit("node").alias("framework"), F.lit("likely").alias("confidence"), F.lit(None).cast("string").alias("version"), F.array(F.lit("has package.json")).alias("evidence")))


def owned_packages(frameworks: DataFrame) -> DataFrame:
    """(project_id, name): packages that a detected framework uses by itself."""
    signals = _signals(frameworks.sparkSession).where("kind = 'package'")
    return frameworks.join(signals, "framework").select("project_id", F.col("signal").alias("name")).distinct()


def _base(files: DataFrame, name: str) -> DataFrame:
    """(project_id, <name>_base): the folder, or the one below src."""
    plain, nested = F.max(F.col("path").startswith(f"{name}/")), F.max(F.col("path").startswith(f"src/{name}/"))
    return files.groupBy("project_id").agg(F.when(plain, F.lit(name)).when(nested, F.lit(f"src/{name}")).alias(f"{name}_base"))


def next_project(files: DataFrame) -> DataFrame:
    """(project_id, router, app_base, pages_base, middleware); projects without a router have no row."""
    places = F.lit(None).cast("int")
    for i, candidate in enumerate(fixed.MIDDLEWARE):
        places = F.when(F.col("path") == candidate, F.lit(i)).otherwise(places)
    middleware = files.withColumn("place", places).where("place IS NOT NULL").groupBy("project_id").agg(F.min_by("path", "place").alias("middleware"))
    both = _base(files, "app").join(_base(files, "pages"), "project_id").where("app_base IS NOT NULL OR pages_base IS NOT NULL")
    router = F.when(F.col("app_base").isNotNull() & F.col("pages_base").isNotNull(), "mixed").when(F.col("app_base").isNotNull(), "app").otherwise("pages")
    return both.join(middleware, "project_id", "left").select("project_id", router.alias("router"), "app_base", "pages_base", "middleware")


def app_files(files: DataFrame, project: DataFrame, facts: DataFrame) -> DataFrame:
    """App Router files with their route folder, kind, rendering and what they export."""
    inside = files.select("project_id", "path").join(project.select("project_id", "app_base"), "project_id").where(F.col("path").startswith(F.concat("app_base", F.lit("/"))))
    special = inside.withColumn("kind", C.special_file(F.col("path"))).where("kind IS NOT NULL")
    known = facts.select("project_id", "path", F.transform("exports", lambda e: e["name"]).alias("names"), F.array_contains("directives", "use client").alias("client"))
    has = lambda n: F.coalesce(F.array_contains("names", n), F.lit(False))
    verbs = F.sort_array(F.array_intersect(F.coalesce("names", F.array().cast("array<string>")), F.array(*map(F.lit, fixed.HTTP_METHODS))))
    return special.join(known, ["project_id", "path"], "left").select(
        "project_id",
        "path",
        C.directory(F.col("path")).alias("dir"),
        "kind",
        F.when(F.col("client"), "client").otherwise("server").alias("rendering"),
        has("generateMetadata").alias("has_generate_metadata"),
        has("generateStaticParams").alias("has_generate_static_params"),
        has("metadata").alias("has_metadata"),
        F.when(F.col("kind") == "route", verbs).otherwise(F.array().cast("array<string>")).alias("http_methods"),
    )


def app_routes(app: DataFrame, project: DataFrame) -> DataFrame:
    """(project_id, dir, segments, files): a route for each folder with special files."""
    routes = app.groupBy("project_id", "dir").agg(F.sort_array(F.collect_list("path")).alias("files")).join(project.select("project_id", "app_base"), "project_id")
    below = F.filter(F.split(F.expr("substring(dir, length(app_base) + 1)"), "/"), lambda s: s != "")
    segments = F.transform(below, lambda s: F.struct(s.alias("raw"), C.segment_kind(s).alias("kind"), C.segment_name(s).alias("name")))
    return routes.select("project_id", "dir", segments.alias("segments"), "files")


def pages_routes(files: DataFrame, project: DataFrame) -> DataFrame:
    """(project_id, path, is_api, is_dynamic) of the Pages Router's modules."""
    inside = files.select("project_id", "path").join(project.select("project_id", "pages_base"), "project_id").where(F.col("path").startswith(F.concat("pages_base", F.lit("/"))))
    kept = inside.where(C.special_file(F.col("path")).isNull() & C.extension(F.col("path")).isin(*fixed.ROUTE_EXTENSIONS))
    parts = F.split(F.regexp_replace("path", r"\.[^./]*$", ""), "/")
    dynamic = F.exists(parts, lambda s: C.segment_kind(s).isin("dynamic", "catch_all", "optional_catch_all"))
    return kept.select("project_id", "path", F.col("path").startswith(F.concat("pages_base", F.lit("/api/"))).alias("is_api"), dynamic.alias("is_dynamic"))


def model(files: DataFrame, facts: DataFrame, project_id: str) -> dict | None:
    """One project's route model, for a person to read; None without a router."""
    own = files.where(F.col("project_id") == project_id)
    found = next_project(own)
    row = found.first()
    if row is None:
        return None
    rows = lambda df: [r.asDict() for r in df.orderBy("path").collect()]
    return {**row.asDict(), "app": rows(app_files(own, found, facts)), "pages": rows(pages_routes(own, found))}
