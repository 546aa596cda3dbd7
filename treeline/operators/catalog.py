"""Module catalog: detection, signals, config values and module cards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeline import settings
from treeline.functions.paths import ancestors, glob_regex, in_skipped_directory, name_regex
from treeline.functions.text import strip, with_lines

ROOT = "."


def parse_settings(lines: DataFrame, keys: list[str]) -> DataFrame:
    """First non-empty value of every key in loose `key = value` / `key: value` text.

    lines: the key columns, line_no, line. Blank, comment and section lines are
    skipped, keys compare in lower case, inline comments and quotes are removed.
    """
    shape = r"""(?U)^["']?([A-Za-z_]\w*)["']?\s*[=:]\s*(.*?)$"""
    text = strip(F.col("line"))
    raw = strip(F.rtrim(strip(F.regexp_extract("_t", shape, 2)), F.lit(",")))
    quoted = raw.rlike(r"""(?s)^(?:".*"|'.*')$""") & (F.length(raw) >= 2)
    value = F.when(quoted, strip(raw.substr(F.lit(2), F.length(raw) - 2))).otherwise(
        strip(F.regexp_replace(raw, r"(?U)\s+[#;].*$", ""))
    )
    pairs = (
        lines.withColumn("_t", text)
        .filter(~F.col("_t").rlike(r"^(?:$|[#;])") & ~F.col("_t").rlike(r"^\[.*\]$") & F.col("_t").rlike(shape))
        .select(*keys, "line_no", F.lower(F.regexp_extract("_t", shape, 1)).alias("key"), value.alias("value"))
        .filter("value <> ''")
    )
    return pairs.groupBy(*keys, "key").agg(F.min_by("value", "line_no").alias("value"))


def detect_modules(
    paths: DataFrame,
    path: str = "file",
    config_file: str = settings.SERVICE_CONFIG,
    suffixes: tuple[str, ...] = settings.EVENT_DIRECTORY_SUFFIXES,
    needed: str = "src",
) -> DataFrame:
    """Directories that are modules: they hold the config file, or carry a suffix and hold `needed/`.

    Every file names the modules it proves, so detection is one distinct.
    """
    p = F.col(path)
    by_config = F.when(p == config_file, F.lit(ROOT)).when(
        p.endswith("/" + config_file), p.substr(F.lit(1), F.length(p) - len(config_file) - 1)
    )
    parts = F.split(p, "/")
    ends = F.lit(False)
    by_name = F.filter(
        F.transform(parts, lambda name, i: F.when(
            _ends_with(name, suffixes) & (F.get(parts, i + 1) == needed) & (i + 2 < F.size(parts)),
            F.array_join(F.slice(parts, F.lit(1), i + 1), "/"),
        )),
        lambda m: m.isNotNull(),
    )
    proofs = F.array_compact(F.concat(F.array(by_config), by_name))
    return paths.select(F.explode(proofs).alias("module_path")).distinct()


def _ends_with(name: Column, suffixes: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for s in suffixes:
        out = out | name.endswith(s)
    return out


def module_files(paths: DataFrame, modules: DataFrame, path: str = "file") -> DataFrame:
    """Every (module_path, file, relative) pair with the file anywhere below the module."""
    below = paths.select(
        path, F.explode(F.concat(F.array(F.lit(ROOT)), ancestors(F.col(path), include_self=False))).alias("module_path")
    )
    return below.join(modules.select("module_path"), "module_path").withColumn(
        "relative",
        F.when(F.col("module_path") == ROOT, F.col(path)).otherwise(
            F.col(path).substr(F.length("module_path") + 2, F.length(path))
        ),
    )


def _below(relative: Column, directory: str) -> Column:
    return relative.startswith(directory + "/")


def _name(relative: Column) -> Column:
    return F.substring_index(relative, "/", -1)


def module_signals(
    owned: DataFrame,
    directories: dict[str, str] = settings.DIRECTORY_SIGNALS,
    names: dict[str, str] = settings.FILENAME_SIGNALS,
) -> DataFrame:
    """One boolean column per signal and module, combined on the map side."""
    relative = F.col("relative")
    return owned.groupBy("module_path").agg(
        *[F.bool_or(_below(relative, d)).alias(n) for n, d in directories.items()],
        *[F.bool_or(_name(relative).rlike(name_regex(p))).alias(n) for n, p in names.items()],
    )


def module_cards(files: DataFrame, config_lines: DataFrame | None = None) -> DataFrame:
    """The module catalog of a repository listing.

    files: file paths (all of them); config_lines: file, line_no, line of the
    service configuration files. The lists of a card hold names only.
    """
    everything = files.select("file")
    visible = everything.filter(~in_skipped_directory(F.col("file"), settings.SKIPPED_DIRECTORIES))
    modules = detect_modules(visible)
    owned = module_files(visible, modules)
    relative, name = F.col("relative"), _name(F.col("relative"))

    def listed(condition: Column, value: Column) -> Column:
        return F.array_sort(F.collect_set(F.when(condition, value)))

    doc_name = F.lit(False)
    for pattern in settings.DOC_NAME_PATTERNS:
        doc_name = doc_name | name.rlike(name_regex(pattern))
    entry = F.lit(False)
    for pattern in settings.ENTRY_PATTERNS:
        entry = entry | relative.rlike(glob_regex(pattern))
    features = owned.groupBy("module_path").agg(
        listed(relative.rlike("^conf/[^/]+$"), name).alias("config_files"),
        listed(doc_name & (~relative.contains("/") | _below(relative, "doc")), relative).alias("doc_files"),
        listed(entry, relative).alias("entry_files"),
        listed(_below(relative, "src") & name.isin(*settings.KEY_FILE_NAMES), relative).alias("extra_key_files"),
    )
    top = module_files(everything, modules).groupBy("module_path").agg(
        listed(relative.contains("/"), F.substring_index("relative", "/", 1)).alias("top_dirs")
    )
    signals = module_signals(owned)
    names = [*settings.DIRECTORY_SIGNALS, *settings.FILENAME_SIGNALS]
    signals = signals.select(
        "module_path", F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.array(*names)).alias("signals")
    )
    cards = features.join(top, "module_path").join(signals, "module_path")
    if config_lines is None:
        found = None
        fields = [F.lit(None).cast("string").alias(f) for f in settings.CONFIG_FIELDS]
        return cards.select("*", *fields)
    home = F.when(F.col("file") == settings.SERVICE_CONFIG, ROOT).otherwise(
        F.col("file").substr(F.lit(1), F.length("file") - len(settings.SERVICE_CONFIG) - 1)
    )
    found = parse_settings(config_lines.withColumn("module_path", home), ["module_path"])
    values = found.groupBy("module_path").agg(
        *[F.max(F.when(F.col("key") == f, F.col("value"))).alias(f) for f in settings.CONFIG_FIELDS]
    )
    return cards.join(values, "module_path", "left")


def cards_of(files: DataFrame) -> DataFrame:
    """Module cards from a table of files with text."""
    config = files.filter(
        F.col("file").endswith("/" + settings.SERVICE_CONFIG) | (F.col("file") == settings.SERVICE_CONFIG)
    )
    return module_cards(files, with_lines(config.select("file", "text")))


def plain_modules(cards: DataFrame, n: int = settings.TOP_NAMES) -> DataFrame:
    """A few modules without a type and a few without any signal."""
    untyped = cards.filter(F.col("module_type").isNull()).select(F.lit("no type").alias("lack"), "module_path")
    silent = cards.filter(~F.exists(F.map_values("signals"), lambda x: x)).select(
        F.lit("no signal").alias("lack"), "module_path"
    )
    return untyped.orderBy("module_path").limit(n).unionByName(silent.orderBy("module_path").limit(n))
