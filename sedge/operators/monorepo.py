"""Packages of a source tree: which package a file belongs to, and which packages need each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def assign(files: DataFrame, packages: DataFrame, fallback: str | None = None) -> DataFrame:
    """path, package: the deepest package folder that the path is in (or that it is), else fallback.

    Each path meets its own folders by equality, so nothing is compared with every package.
    """
    parts = F.split("path", "/")
    prefix = F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/")))
    found = files.select("path").distinct().select("path", prefix.alias("package")).join(packages.select("package").distinct(), "package", "left_semi")
    deepest = found.groupBy("path").agg(F.max_by("package", F.length("package")).alias("package"))
    if fallback is None:
        return deepest
    return files.select("path").distinct().join(deepest, "path", "left").select("path", F.coalesce("package", F.lit(fallback)).alias("package"))


def plain_name(name: Column) -> Column:
    return F.lower(F.replace(name, F.lit("-"), F.lit("_")))


def import_forms(imp: Column) -> Column:
    """The names that an import may give a package."""
    parts = F.split(imp, "/")
    bare = lambda c: F.replace(c, F.lit("@"))
    forms = F.array(imp, bare(imp), bare(parts[0]), F.substring_index(imp, ".", 1))
    nested = F.when(imp.contains("/"), F.array(F.element_at(parts, -1))).otherwise(F.array().cast("array<string>"))
    scoped = F.when(imp.startswith("@") & imp.contains("/"), F.array(F.get(parts, F.lit(1)), F.array_join(F.slice(parts, 1, 2), "/"))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(forms, nested, scoped))


#: From this length on a name may be a part of another one.
PART = 4


def grams(name: Column) -> Column:
    """Every different substring of PART characters."""
    n = F.length(name)
    cut = F.transform(F.sequence(F.lit(1), F.greatest(n - PART + 1, F.lit(1))), lambda i: F.substr(name, i, F.lit(PART)))
    return F.array_distinct(F.filter(cut, lambda s: F.length(s) == PART))


def holding(long: DataFrame, short: DataFrame) -> DataFrame:
    """long, short: values of long that hold one of short of PART characters or more. They meet at the first
    PART characters of the short one, by equality, and are then compared."""
    heads = short.filter(F.length("short") >= PART).select("short", F.substring("short", 1, PART).alias("gram"))
    return long.select("long", F.explode(grams(F.col("long"))).alias("gram")).join(heads, "gram").filter(F.contains("long", F.col("short"))).select("long", "short").distinct()


def dependencies(imports: DataFrame, packages: DataFrame | None = None) -> DataFrame:
    """package, depends_on: packages that an import (package, imp) of another package means.

    packages (package) are all there are; without them, those that import something.

    A form of the import and the package's name are equal (case and dashes aside), or the one holds
    the other, if that has four characters or more. The two meet at parts of four characters, so no
    import is compared with every package, and work is linear in their lengths.
    """
    names = (packages or imports).select(F.col("package").alias("depends_on"), plain_name(F.col("package")).alias("name")).distinct()
    forms = imports.select("imp").distinct().select("imp", F.explode(import_forms(F.col("imp"))).alias("form")).select("imp", plain_name(F.col("form")).alias("form")).distinct()
    equal = forms.join(names, F.col("form") == F.col("name")).select("imp", "depends_on")
    a, b = forms.select("form").distinct(), names.select("name").distinct()
    in_form = holding(a.toDF("long"), b.toDF("short")).toDF("form", "name")
    in_name = holding(b.toDF("long"), a.toDF("short")).toDF("name", "form")
    holds, held = (forms.join(p, "form").join(names, "name").select("imp", "depends_on") for p in (in_form, in_name))
    known = equal.unionByName(holds).unionByName(held).distinct()
    return imports.join(known, "imp").filter("package <> depends_on").select("package", "depends_on").distinct()


def match(packages: DataFrame, task: str) -> DataFrame:
    """The first package by name that the task mentions, else root, else the first of all."""
    rank = F.when(F.contains(F.lit(task.lower()), F.lower("package")), 0).when(F.col("package") == "root", 1).otherwise(2)
    return packages.orderBy(rank, "package").limit(1)


def root_map(files: DataFrame, kinds: DataFrame, edges: DataFrame) -> DataFrame:
    """package, line: a line of the cluster map for each package.

    files has package; kinds package, kind, rel_path; edges package, depends_on.
    """
    sizes = files.groupBy("package").agg(F.count("*").alias("n"))
    needs = edges.groupBy("package").agg(F.array_join(F.array_sort(F.collect_set("depends_on")), ", ").alias("needs"))
    rows = kinds.join(sizes, "package", "left").join(needs, "package", "left")
    head = F.format_string("• %s [%s, %d files, %s]", "package", "kind", F.coalesce("n", F.lit(0)), F.when(F.col("rel_path") == "", ".").otherwise(F.col("rel_path")))
    return rows.select("package", F.concat(head, F.when(F.col("needs").isNull(), "").otherwise(F.concat(F.lit(" -> "), "needs"))).alias("line"))

