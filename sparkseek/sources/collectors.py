"""Catalogues of named things from ranked sources, as DataFrames of one schema.

A collector reads what was harvested on the machines (JSON lines or Parquet); what only the
machine itself can list is an input table here.  The order of ``PRECEDENCE`` decides which of two
records of one thing survives."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.build import content_hash, entity_id, first_wins
from ..schema import ENTITIES
from .catalogues import CONTROL_NAMES, SETTINGS_PAGES, SUITE_UTILITIES, SYSTEM_TOOLS

# Sources in the order of precedence.
PRECEDENCE = ("appsfolder", "powertoys", "startmenu", "uninstall", "mssettings", "controlpanel", "optionalfeature", "systemtool", "command", "path")
MAX_PATH_EXECUTABLES = 512


def conform(rows: DataFrame, source: str) -> DataFrame:
    """The entity schema: absent columns null, id and hash filled in."""
    have = set(rows.columns)
    value = lambda f: F.col(f.name).cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)
    out = rows.select(*(value(f).alias(f.name) for f in ENTITIES.fields if f.name != "id"), *(["key"] if "key" in have else []), *(["id"] if "id" in have else []))
    out = out.withColumn("source", F.lit(source))
    out = out.withColumn("id", entity_id(F.lit(source), F.col("key")) if "key" in have else F.col("id"))
    hashed = content_hash([F.col(c) for c in ("display_name", "kind", "launch_kind", "launch_target", "launch_arguments", "icon_source", "publisher")], F.col("raw_metadata"))
    return out.withColumn("content_hash", hashed).select(*ENTITIES.names)


def read_source(spark: SparkSession, path: str, source: str, form: str = "json") -> DataFrame:
    return conform(spark.read.format(form).load(path), source)


def _meta(**pairs: Column) -> Column:
    """A map of the pairs that have a value."""
    entries = F.array(*(F.struct(F.lit(k).alias("key"), F.trim(v).alias("value")) for k, v in sorted(pairs.items())))
    return F.map_from_entries(F.filter(entries, lambda e: F.coalesce(F.length(e["value"]) > 0, F.lit(False))))


def file_stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^\\/]*?)(?:\.[^.\\/]*)?$", 1)


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^\\/]*)$", 1)


def settings_pages(spark: SparkSession) -> DataFrame:
    df = spark.createDataFrame(SETTINGS_PAGES, "display_name string, launch_target string, description string")
    return conform(df.select("display_name", "launch_target", F.lit(2).alias("kind"), F.lit(3).alias("launch_kind"), F.col("launch_target").alias("key"), _meta(description=F.col("description")).alias("raw_metadata")), "mssettings")


def suite_utilities(spark: SparkSession, runner: str | None, suite: str = "Microsoft PowerToys", articles: str = "https://learn.microsoft.com/en-us/windows/powertoys/") -> DataFrame:
    """The utilities that one runner hosts; none without a runner.  They share its target, and a name
    is one within the suite only, but where a utility merges with a program of its own."""
    df = spark.createDataFrame(SUITE_UTILITIES if runner else [], "display_name string, page string, article string, description string, merged boolean")
    run = F.lit(runner or "").cast("string")
    meta = _meta(description=F.col("description"), fileName=file_name(run), learnArticle=F.concat(F.lit(articles), "article"), settingsPage=F.col("page"), sharedLaunchTarget=F.lit("true"), suite=F.lit(suite), targetPath=run, dedupeScope=F.when(~F.col("merged"), suite))
    return conform(df.select("display_name", F.lit(0).alias("kind"), F.lit(1).alias("launch_kind"), run.alias("launch_target"), F.concat(F.lit("--open-settings="), "page").alias("launch_arguments"), run.alias("icon_source"), F.lit("Microsoft Corporation").alias("publisher"), meta.alias("raw_metadata"), F.col("display_name").alias("key")), "powertoys")


def system_tools(spark: SparkSession, files: DataFrame) -> DataFrame:
    """The known tools that are there.  files: (path)."""
    known = spark.createDataFrame(SYSTEM_TOOLS, "file string, display_name string, description string")
    rows = files.select("path", F.lower(file_name(F.col("path"))).alias("plain")).join(F.broadcast(known.withColumn("plain", F.lower("file"))), "plain")
    return conform(rows.select("display_name", F.lit(6).alias("kind"), F.lit(1).alias("launch_kind"), F.col("path").alias("launch_target"), F.col("path").alias("icon_source"), _meta(description=F.col("description"), fileName=F.col("file")).alias("raw_metadata"), F.col("path").alias("key")), "systemtool")


def control_items(spark: SparkSession, files: DataFrame) -> DataFrame:
    """Applets and consoles by a known name, else by what the file says of itself, else by the file's
    name.  files: (path, file_description)."""
    known = spark.createDataFrame(list(CONTROL_NAMES.items()), "plain string, friendly string")
    rows = files.withColumn("file", file_name(F.col("path"))).withColumn("plain", F.lower("file")).where(F.regexp_like("plain", F.lit(r"\.(cpl|msc)$"))).join(F.broadcast(known), "plain", "left")
    said = F.nullif(F.trim("file_description"), F.lit(""))
    applet = F.col("plain").endswith(".cpl")
    name = F.coalesce("friendly", said, file_stem(F.col("path")))
    return conform(rows.select(name.alias("display_name"), F.when(applet, 3).otherwise(4).alias("kind"), F.when(applet, 4).otherwise(5).alias("launch_kind"), F.col("path").alias("launch_target"), F.col("path").alias("icon_source"), _meta(fileName=F.col("file"), fileDescription=said).alias("raw_metadata"), F.col("path").alias("key")), "controlpanel")


def shell_apps(rows: DataFrame) -> DataFrame:
    """Applications of the shell (name, model_id): packaged if the id names an application in a package."""
    kept = rows.where((F.length(F.trim("name")) > 0) & (F.length(F.trim("model_id")) > 0))
    packaged = F.col("model_id").contains("!")
    return conform(kept.select(F.col("name").alias("display_name"), F.when(packaged, 1).otherwise(0).alias("kind"), F.lit(0).alias("launch_kind"), F.col("model_id").alias("launch_target"), _meta(appUserModelId=F.col("model_id")).alias("raw_metadata"), F.col("model_id").alias("key")), "appsfolder")


def start_shortcuts(links: DataFrame) -> DataFrame:
    """Shortcuts (path, folder, target, working_directory, comment, icon, arguments, url): links carry
    their target, internet shortcuts their address."""
    link = F.lower("path").endswith(".lnk")
    own = lambda c: F.when(link, F.col(c))
    blank = lambda c: F.nullif(F.trim(own(c)), F.lit(""))
    meta = _meta(startMenuFolder=F.col("folder"), targetPath=own("target"), workingDirectory=own("working_directory"), comment=own("comment"), url=F.when(~link, F.col("url")))
    rows = links.where(F.regexp_like(F.lower("path"), F.lit(r"\.(lnk|url)$")) & (F.length(file_stem(F.col("path"))) > 0))
    return conform(rows.select(file_stem(F.col("path")).alias("display_name"), F.lit(0).alias("kind"), F.lit(2).alias("launch_kind"), F.col("path").alias("launch_target"), blank("arguments").alias("launch_arguments"), blank("icon").alias("icon_source"), meta.alias("raw_metadata"), F.col("path").alias("key")), "startmenu")


def trimmed_path(value: Column) -> Column:
    """A path as registries write it: what stands in the leading quotes, or all without a trailing
    resource number."""
    value = F.trim(value)
    quoted = F.regexp_extract(value, r'^"([^"]+)"', 1)
    bare = F.trim(F.regexp_replace(F.regexp_replace(value, r"(?<=.),\s*-?\d+\s*$", ""), r'^[" ]+|[" ]+$', ""))
    return F.nullif(F.when(quoted != "", quoted).otherwise(bare), F.lit(""))


def executable_of(value: Column) -> Column:
    """The path up to its first .exe; all of it without one."""
    path = trimmed_path(value)
    cut = F.regexp_extract(path, r"(?is)^(.*?\.exe)", 1)
    return F.when(cut != "", F.regexp_replace(cut, r'^[" ]+|[" ]+$', "")).otherwise(path)


def uninstall_records(records: DataFrame, files: DataFrame) -> DataFrame:
    """Installed programs (root, key, display_name, system_component, display_icon, publisher,
    install_location, display_version, uninstall_string): components and blank names are skipped.

    The target is the icon's program if it is there, else the first program of the install folder
    (no uninstaller or setup if another is there, the shortest path), else the uninstaller, else
    whatever the record says.  files: (path) of the programs that exist."""
    there = files.select(F.lower("path").alias("plain"), "path").distinct()
    kept = records.where((F.length(F.trim("display_name")) > 0) & (F.coalesce("system_component", F.lit(0)) != 1))
    kept = kept.withColumn("icon_path", executable_of(F.col("display_icon"))).withColumn("folder", F.lower(F.regexp_replace(trimmed_path(F.col("install_location")), r"[\\/]+$", "")))
    folder = F.regexp_extract("path", r"^(.*)[\\/][^\\/]*$", 1)
    helper = F.regexp_like(F.lower("path"), F.lit("unins|setup"))
    best = files.where(F.lower("path").endswith(".exe")).groupBy(F.lower(folder).alias("folder")).agg(F.min(F.struct(helper.alias("helper"), F.length("path").alias("size"), "path")).alias("b")).select("folder", F.col("b.path").alias("folder_exe"))
    icons = there.where(F.col("plain").endswith(".exe")).select(F.col("plain").alias("icon_plain"))
    rows = kept.join(best, "folder", "left").withColumn("icon_plain", F.lower("icon_path")).join(icons.withColumn("icon_there", F.lit(True)), "icon_plain", "left")
    some = lambda c: F.nullif(F.trim(c), F.lit(""))
    target = uninstall_target(F.when(F.col("icon_there"), F.col("icon_path")), F.col("folder_exe"), executable_of(F.col("uninstall_string")), F.col("icon_path"), F.coalesce(some("display_icon"), some("install_location"), some("uninstall_string"), F.col("display_name")))
    meta = _meta(registryKey=F.col("key"), displayVersion=F.col("display_version"), installLocation=F.col("install_location"), displayIcon=F.col("display_icon"), uninstallString=F.col("uninstall_string"))
    return conform(rows.select("display_name", F.lit(0).alias("kind"), F.lit(1).alias("launch_kind"), target.alias("launch_target"), F.col("display_icon").alias("icon_source"), some("publisher").alias("publisher"), meta.alias("raw_metadata"), F.concat_ws("\\", "root", F.col("key")).alias("key")), "uninstall")


def tool_name(stem: Column, product: Column, most: int = 64) -> Column:
    """The product's name if it is short and about this tool, else the command."""
    product = F.nullif(F.trim(product), F.lit(""))
    return F.when((F.length(product) <= most) & F.lower(product).contains(F.lower(stem)), product).otherwise(stem)


def command_aliases(aliases: DataFrame) -> DataFrame:
    """Registered commands (alias, target, product, company, file_description, subsystem) whose target
    is there; those of the console (subsystem 3) are tools."""
    rows = aliases.where(F.lower("alias").endswith(".exe") & F.col("target").isNotNull()).withColumn("stem", file_stem(F.col("alias")))
    return _programs(rows, "command", appPathAlias=F.col("alias"))


def _programs(rows: DataFrame, source: str, **more: Column) -> DataFrame:
    console = F.coalesce(F.col("subsystem") == 3, F.lit(False))
    meta = _meta(targetPath=F.col("target"), command=F.col("stem"), description=F.col("file_description"), consoleSubsystem=F.when(console, "true"), **more)
    return conform(rows.select(tool_name(F.col("stem"), F.col("product")).alias("display_name"), F.when(console, 6).otherwise(0).alias("kind"), F.lit(1).alias("launch_kind"), F.col("target").alias("launch_target"), F.col("target").alias("icon_source"), F.nullif(F.trim("company"), F.lit("")).alias("publisher"), meta.alias("raw_metadata"), F.col("target").alias("key")), source)


def path_entities(files: DataFrame, root: str = "C:\\Windows") -> DataFrame:
    """Programs of the search path (directory, position, file, size, product, company,
    file_description, subsystem) outside the system's own folders; ids keep to the path."""
    low = root.lower().rstrip("\\/")
    own = F.lower(F.regexp_replace("directory", r"[\\/]+$", ""))
    kept = path_executables(files.where((own != low) & ~own.startswith(low + "\\")))
    rows = kept.withColumn("target", F.concat_ws("\\", F.regexp_replace("directory", r"[\\/]+$", ""), "file")).withColumn("stem", file_stem(F.col("file"))).where("stem <> ''")
    return _programs(rows, "path", pathDirectory=F.col("directory"))


def model_id_parts(model_id: Column) -> tuple[Column, Column]:
    """Family and application of an application's model id."""
    value = F.regexp_replace(F.trim(model_id), r"(?i)^shell:AppsFolder\\", "")
    app = F.regexp_extract(value, r"^[^!]*!(.+)$", 1)
    return F.nullif(F.substring_index(value, "!", 1), F.lit("")), F.nullif(app, F.lit(""))


def package_executables(apps: DataFrame, manifests: DataFrame, binaries: DataFrame) -> DataFrame:
    """(id, executable): what each packaged application runs.

    apps: (id, model_id); manifests: (family, app, executable); binaries: (family, path), relative to
    the package.  An id without an application means the package's only one.  A program that several
    applications share is a stub: then the binary named after the application counts, at the top
    or one folder down, or none."""
    family, app = model_id_parts(F.col("model_id"))
    asked = apps.select("id", family.alias("family"), app.alias("app"))
    per = manifests.groupBy("family").agg(F.count("*").alias("n"), F.min("executable").alias("only"))
    shared = manifests.groupBy("family", F.lower("executable").alias("x")).agg((F.count("*") > 1).alias("stub"))
    rows = asked.join(per, "family")
    named = manifests.select("family", F.lower("app").alias("lower_app"), F.col("executable").alias("told"))
    rows = rows.withColumn("lower_app", F.lower("app")).join(named, ["family", "lower_app"], "left")
    rows = rows.withColumn("executable", F.coalesce("told", F.when(F.col("n") == 1, F.col("only")))).where("executable is not null")
    rows = rows.withColumn("x", F.lower("executable")).join(shared, ["family", "x"], "left")
    depth = F.size(F.split(F.regexp_replace("path", r"\\", "/"), "/"))
    own = binaries.where(depth <= 2).select("family", F.lower(file_stem(F.col("path"))).alias("lower_app"), depth.alias("depth"), "path").groupBy("family", "lower_app").agg(F.min(F.struct("depth", "path")).alias("b")).select("family", "lower_app", F.col("b.path").alias("own"))
    rows = rows.join(own, ["family", "lower_app"], "left")
    same = F.lower(file_stem(F.col("executable"))) == F.col("lower_app")
    chosen = F.when(F.col("lower_app").isNull() | same, F.col("executable")).otherwise(F.coalesce("own", F.when(~F.coalesce("stub", F.lit(False)), F.col("executable"))))
    return rows.select("id", chosen.alias("executable")).where("executable is not null")


def path_executables(files: DataFrame) -> DataFrame:
    """Files (directory, position, file, size) of a search path: crowded directories are
    skipped, the first of a name wins, and an empty file hides later ones but is none itself."""
    crowded = files.groupBy("directory").agg(F.count("*").alias("n")).where(F.col("n") > MAX_PATH_EXECUTABLES).select("directory")
    kept = files.join(crowded, "directory", "left_anti").withColumn("plain", F.lower("file"))
    return first_wins(kept, ["plain"], ["position", "file"]).where("size > 0").drop("plain")


def merge_catalogue(found: DataFrame, catalogue: DataFrame) -> DataFrame:
    """What was found, and of the catalogue what is not present by name."""
    names = found.select(F.upper("display_name").alias("__u")).distinct()
    more = catalogue.join(names, F.upper("display_name") == F.col("__u"), "left_anti")
    return found.unionByName(more)


def catalogue_states(catalogue: DataFrame, packages: DataFrame) -> DataFrame:
    """State of each catalogue row (prefix) by packages (name, state, position): Installed
    wins, else the last.  The name before ~ is cut to the lengths of the prefixes, so the
    join is one of equality."""
    lengths = [r[0] for r in catalogue.select(F.length("prefix")).distinct().collect()]  # a handful
    stem = F.lower(F.substring_index("name", "~", 1))
    cut = packages.select("state", "position", F.explode(F.array_distinct(F.array(*(F.substring(stem, 1, n) for n in lengths)))).alias("p"))
    best = cut.groupBy("p").agg(F.max(F.struct((F.col("state") == "Installed").alias("installed"), "position", "state")).alias("b"))
    return catalogue.join(best, F.lower("prefix") == best.p, "left").select(*catalogue.columns, F.col("b.state").alias("state"))


def uninstall_target(icon_exe: Column, folder_exe: Column, uninstall_exe: Column, icon: Column, raw: Column) -> Column:
    """The best launch target that an uninstall record offers."""
    return F.coalesce(*(F.nullif(F.trim(c), F.lit("")) for c in (icon_exe, folder_exe, uninstall_exe, icon, raw)))


def discover(sources: dict[str, Callable[[], DataFrame]], only: list[str] | None = None) -> DataFrame:
    """All sources' rows with their rank; a name that is none of them is an error."""
    unknown = set(only or ()) - set(sources)
    if unknown:
        raise ValueError(f"unknown sources: {', '.join(sorted(unknown))}; known: {', '.join(sources)}")
    used = [s for s in sorted(sources, key=lambda s: PRECEDENCE.index(s) if s in PRECEDENCE else len(PRECEDENCE)) if not only or s in only]
    return reduce(DataFrame.unionByName, [sources[s]().withColumn("rank", F.lit(i)) for i, s in enumerate(used)])
