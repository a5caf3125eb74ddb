"""Import resolution over a whole project by joins with lookup tables, in place of one machine's maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelode.functions.text import basename, dirname, strip_extension
from codelode.operators import ranges
from codelode.parse.languages import INDEX_FILES


def lookups(paths: DataFrame) -> dict[str, DataFrame]:
    """Lookup tables from what an import may say (key) to a file (path): exact, stem, index and go.

    Of several files, one that is no .d.ts file wins, then the first in order of path.
    """
    p = F.col("path")
    files = paths.select("path").distinct().withColumn("dts", F.endswith(p, F.lit(".d.ts")))
    best = lambda df: df.groupBy("key").agg(F.min(F.struct("late", "path")).alias("b")).select("key", "b.path")
    own = files.select(strip_extension(p).alias("key"), "path", F.when(F.col("dts"), 1).otherwise(0).alias("late")).where("key != path")
    typed = files.where("dts").select(strip_extension(strip_extension(p)).alias("key"), "path", F.lit(1).alias("late"))
    stem = F.when(F.col("dts"), strip_extension(strip_extension(basename(p)))).otherwise(strip_extension(basename(p)))
    ext = F.regexp_extract(p, r"(\.[^./]*)$", 1)
    index = F.lit(False)
    for name, allowed in INDEX_FILES.items():
        index = index | ((stem == name) & ext.isin(*allowed.split()))
    folder = files.select(dirname(p).alias("key"), "path", F.when(F.col("dts"), 1).otherwise(0).alias("late"), index.alias("index"), ext.alias("ext"))
    return {"exact": files.select(p.alias("key"), "path"), "stem": best(own.unionByName(typed)), "index": best(folder.where("index").select("key", "path", "late")), "go": best(folder.where("ext = '.go'").select("key", "path", F.lit(0).alias("late")))}


def specifier_path(name: Column, language: Column, go_module: str = "") -> Column:
    """The path that an import outside the relative ones may mean; null if none."""
    go = F.when(F.startswith(name, F.lit(go_module + "/")), F.substring(name, len(go_module) + 2, 10000)) if go_module else F.lit(None).cast("string")
    dotted = F.replace(name, F.lit("."), F.lit("/"))
    return (
        F.when(language == "go", go)
        .when(language.isin("java", "kotlin", "csharp"), dotted)
        .when(language == "php", F.replace(F.regexp_replace(name, r"^\\", ""), F.lit("\\"), F.lit("/")))
        .when((language == "python") & ~F.startswith(name, F.lit(".")), dotted)
    )


def resolve_imports(imports: DataFrame, paths: DataFrame, go_module: str = "") -> DataFrame:
    """imports (language, import_name, import_type, target_file_path) with targets resolved to files of the project.

    Internal ones are looked up by their target; external ones that turn out to be files of the project become internal. Lookup
    tables are as large as the project, so joins are left to the optimizer.
    """
    columns = imports.columns
    internal = (F.col("import_type") == "INTERNAL") & (F.coalesce("target_file_path", F.lit("")) != "")
    outside = (F.col("import_type") == "EXTERNAL") & (F.coalesce("target_file_path", F.lit("")) == "")
    rows = imports.withColumn("__key", F.when(internal, F.col("target_file_path")).when(outside, specifier_path(F.col("import_name"), F.col("language"), go_module)))
    for name, table in lookups(paths).items():
        rows = rows.join(table.withColumnsRenamed({"key": f"__k_{name}", "path": f"__{name}"}), F.col("__key") == F.col(f"__k_{name}"), "left").drop(f"__k_{name}")
    found = F.coalesce("__exact", "__stem", "__index", F.when(outside & (F.col("language") == "go"), F.col("__go")))
    rows = rows.withColumn("__found", found)
    target = F.when(F.col("__found").isNotNull(), F.col("__found")).otherwise(F.col("target_file_path"))
    kind = F.when(outside & F.col("__found").isNotNull(), "INTERNAL").otherwise(F.col("import_type"))
    return rows.withColumns({"target_file_path": target, "import_type": kind}).select(*columns)


def enclosing_symbol(points: DataFrame, symbols: DataFrame, file: str = "file", line: str = "line", key: str = "ref_id") -> DataFrame:
    """points with symbol_id of the symbol with the fewest lines around each, the first on ties; null if none. See ranges.tightest."""
    return ranges.tightest(points, symbols, [file], key, line, "start_line", "end_line", "symbol_id", "ordinal")
