"""Artifact catalog: canonical entries, consistency checks, lookups, bindings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark import constants as K
from tallymark.functions.payload import texts
from tallymark.functions.text import strip
from tallymark.operators.skew import lookup_join


def _empty() -> Column:
    return texts([])


def _filled(name: str) -> Column:
    return F.size(F.coalesce(F.col(name), _empty())) > 0


def normalize_entries(entries: DataFrame) -> DataFrame:
    """serving_target and serving_targets completed from each other."""
    single = F.nullif("serving_target", F.lit(""))
    others = [name for name in entries.columns if name not in ("serving_target", "serving_targets")]
    return entries.select(
        *others,
        F.coalesce(single, F.try_element_at("serving_targets", F.lit(1))).alias("serving_target"),
        F.when(~_filled("serving_targets") & single.isNotNull(), F.array(single))
        .otherwise(F.col("serving_targets"))
        .alias("serving_targets"),
    )


def targets_of() -> Column:
    """Declared targets of an entry, an empty array when it names none."""
    single = F.nullif("serving_target", F.lit(""))
    return (
        F.when(_filled("serving_targets"), F.col("serving_targets"))
        .when(single.isNotNull(), F.array(single))
        .otherwise(_empty())
    )


def add_quantization(entries: DataFrame, quantization: str) -> DataFrame:
    """Effect of a conversion: one more quantisation and the converted targets."""
    added = texts(list(K.CONVERTED_TARGETS))
    return entries.withColumn(
        "quantizations", _append(F.coalesce("quantizations", _empty()), F.array(F.lit(quantization)))
    ).withColumn("serving_targets", _append(F.coalesce("serving_targets", _empty()), added))


def _append(present: Column, added: Column) -> Column:
    return F.concat(present, F.array_except(added, present))


def allowed_targets(fmt: Column) -> Column:
    """Targets a format can run on; NULL for an unknown format (no restriction). The
    table is configuration of three rows, so it is part of the expression."""
    result = F
    for name, targets in K.FORMAT_TARGETS.items():
        result = result.when(fmt == name, texts(list(targets)))
    return result


def incompatible_targets(targets: Column, fmt: Column) -> Column:
    """Targets the format cannot run on, in declared order, repeats kept."""
    allowed = allowed_targets(fmt)
    return F.filter(targets, lambda target: F.coalesce(~F.array_contains(allowed, target), F.lit(False)))


def check_compatibility(entries: DataFrame) -> DataFrame:
    targets = targets_of()
    return entries.select(
        "*",
        F.array_join(incompatible_targets(targets, F.col("format")), ", ").alias("incompatible"),
        F.array_join(F.sort_array(allowed_targets(F.col("format"))), ", ").alias("allowed"),
    )


def dir_rollup(files: DataFrame) -> DataFrame:
    """Per artifact directory: size in GB over everything below it, format by the
    extensions of its direct files. files: dir, rel_path, length."""
    direct = ~F.col("rel_path").contains("/")
    flags = [
        F.bool_or(direct & F.col("rel_path").endswith(suffix)).alias(f"_{fmt}") for suffix, fmt in K.DETECTION_ORDER
    ]
    found = F
    for _, fmt in K.DETECTION_ORDER:
        found = found.when(F.col(f"_{fmt}"), F.lit(fmt))
    return (
        files.groupBy("dir")
        .agg(F.sum("length").alias("bytes"), F.count(F.lit(1)).alias("files"), *flags)
        .select(
            "dir",
            "bytes",
            "files",
            F.round(F.col("bytes") / 1e9, 1).alias("size_gb"),
            found.otherwise(F.lit("unknown")).alias("format"),
        )
    )


def _direct_suffixes(files: DataFrame) -> DataFrame:
    """Per directory, whether a direct file has each suffix of interest."""
    direct = ~F.col("rel_path").contains("/")
    return files.groupBy("dir").agg(
        *[
            F.bool_or(direct & F.col("rel_path").endswith(suffix)).alias(f"_has_{fmt}")
            for fmt, suffix in K.FORMAT_SUFFIX.items()
        ]
    )


def check_catalog(entries: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Adds check_status: the first failing rule per entry, or OK. Without a file
    inventory only the metadata is checked."""
    targets = targets_of()
    unknown = F.filter(targets, lambda target: ~target.isin(*K.KNOWN_TARGETS))
    wrong = incompatible_targets(targets, F.col("format"))
    allowed = F.array_join(F.sort_array(allowed_targets(F.col("format"))), ", ")
    status = F
    checked = entries
    if files is not None:
        found = _direct_suffixes(files).withColumnRenamed("dir", "path").withColumn("_present", F.lit(True))
        checked = lookup_join(entries, found, ["path"], ["id"])
        status = status.when(F.col("_present").isNull(), F.lit("MISSING"))
        for fmt, suffix in K.FORMAT_SUFFIX.items():
            status = status.when(
                (F.col("format") == fmt) & ~F.col(f"_has_{fmt}"), F.lit(f"WARN: no {suffix} files")
            )
    status = status.when(
        F.size(unknown) > 0, F.concat(F.lit("WARN: invalid target(s): "), F.array_join(unknown, ", "))
    ).when(
        F.size(wrong) > 0,
        F.concat(
            F.lit("WARN: "), F.col("format"), F.lit(" incompatible with target(s): "),
            F.array_join(wrong, ", "), F.lit("; allowed: "), allowed,
        ),
    )
    return checked.select(*entries.columns, status.otherwise(F.lit("OK")).alias("check_status"))


def issue_count(checked: DataFrame) -> DataFrame:
    return checked.agg(F.count(F.lit(1)).alias("entries"), F.count_if(F.col("check_status") != "OK").alias("issues"))


def _first_per_target(entries: DataFrame, order: str) -> DataFrame:
    """First catalog entry per (model_id, runtime)."""
    by_target = entries.select(
        F.col("id").alias("model_id"), F.explode(F.array_distinct(targets_of())).alias("runtime"), order, "format", "path"
    )
    picked = F.struct(F.col("format").alias("format"), F.col("path").alias("path"))
    return by_target.groupBy("model_id", "runtime").agg(F.min_by(picked, order).alias("_entry"))


def resolve_targets(requests: DataFrame, entries: DataFrame, order: str = "position") -> DataFrame:
    """Adds path, format and resolve_error. requests: request_id, model_id, runtime."""
    joined = lookup_join(requests, _first_per_target(entries, order), ["model_id", "runtime"], ["request_id"])
    fmt = F.col("_entry")["format"]
    allowed = allowed_targets(fmt)
    error = (
        F.when(~F.col("runtime").isin(*K.REGISTRY_RUNTIMES), F.concat(F.lit("unknown runtime "), F.col("runtime")))
        .when(F.col("_entry").isNull(), F.lit("model not found or not targeted for runtime"))
        .when(
            F.coalesce(~F.array_contains(allowed, F.col("runtime")), F.lit(False)),
            F.concat(F.lit("format "), fmt, F.lit(" is not compatible with "), F.col("runtime")),
        )
    )
    return joined.select(
        *requests.columns,
        fmt.alias("format"),
        F.col("_entry")["path"].alias("path"),
        error.alias("resolve_error"),
    )


def missing_bindings(listed: DataFrame, bindings: DataFrame, runtime: str = "ollama") -> DataFrame:
    """Listed model names without a binding, with how often they are listed."""
    names = (
        listed.filter(F.coalesce(F.col("name"), F.lit("")) != "")
        .groupBy("name")
        .agg(F.count(F.lit(1)).alias("listed"))
    )
    bound = bindings.filter(F.col("runtime") == runtime).select(F.col("model_name").alias("name")).distinct()
    return names.join(bound, "name", "left_anti")


def check_bindings(bindings: DataFrame, entries: DataFrame) -> DataFrame:
    """Adds binding_error: first broken rule per binding. bindings: id, runtime,
    model_type, model_id, model_name, provider, gateway_model."""
    resolved = resolve_targets(
        bindings.withColumn("request_id", F.col("id")), entries
    )

    def blank(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit("")) == ""

    runtime, kind = F.col("runtime"), F.coalesce(F.col("model_type"), F.lit("None"))
    error = (
        F.when(
            ~F.coalesce(runtime.isin(*K.BINDING_RUNTIMES), F.lit(False)),
            F.concat(F.lit("unsupported runtime: "), F.coalesce(runtime, F.lit("None"))),
        )
        .when((kind == "registry") & blank("model_id"), F.lit("registry model needs model.id"))
        .when(
            (kind == "registry") & ~runtime.isin(*K.REGISTRY_RUNTIMES),
            F.concat(F.lit("uses registry model but runtime "), runtime, F.lit(" has no env mapping")),
        )
        .when((kind == "registry") & F.col("resolve_error").isNotNull(), F.col("resolve_error"))
        .when(
            (kind == "ollama") & (runtime != "ollama"),
            F.concat(F.lit("uses ollama model type with runtime "), runtime),
        )
        .when((kind == "ollama") & blank("model_name"), F.lit("ollama model needs model.name"))
        .when(~kind.isin("registry", "ollama"), F.concat(F.lit("unsupported model.type: "), kind))
        .when(blank("provider") | blank("gateway_model"), F.lit("needs gateway.provider and gateway.model"))
    )
    return resolved.select(*bindings.columns, error.alias("binding_error"))


def parse_settings(lines: DataFrame) -> DataFrame:
    """KEY=value lines; comments and lines without '=' are skipped, quotes dropped.
    lines: service, layer, line_no, text."""
    text = strip(F.col("text"))
    value = F.regexp_replace(strip(F.regexp_replace(text, "^[^=]*=", "")), '^"+|"+$', "")
    return (
        lines.filter((text != "") & ~text.startswith("#") & text.contains("="))
        .select(
            "service",
            "layer",
            "line_no",
            strip(F.split_part(text, F.lit("="), F.lit(1))).alias("key"),
            F.regexp_replace(value, "^'+|'+$", "").alias("value"),
        )
    )


def overlay_merge(settings: DataFrame) -> DataFrame:
    """Last writer per key: a later layer wins, then the later line."""
    return settings.groupBy("service", "key").agg(F.max_by("value", F.struct("layer", "line_no")).alias("value"))


def services_by_group(services: DataFrame, group: str) -> DataFrame:
    return services.filter(F.col("group") == group)


def with_value(services: DataFrame, name: str) -> DataFrame:
    """Services that set a value (an endpoint, a runtime check, an image)."""
    return services.filter(F.coalesce(F.col(name), F.lit("")) != "")


def distinct_files(services: DataFrame, name: str = "compose_file") -> DataFrame:
    return with_value(services, name).select(name).distinct()
