"""Layered configuration: defaults under profiles under device rules under a preset under command-line values.

A profile is a row; all its settings are columns named by setting (section.key without the section), so that any number
of profiles resolves in one pass without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tessera.functions.paths import join_path, present_or

#: Section, key, type, default, name among the training parameters (or None), whether a snapshot keeps it.
REGISTRY = (
    ("model", "architecture", "string", "yolo11n.pt", None, True),
    ("model", "use_best_weights", "boolean", False, None, True),
    ("training", "run_name", "string", "run", "name", True),
    ("training", "image_size", "bigint", 640, "imgsz", True),
    ("training", "batch_size", "bigint", -1, "batch", True),
    ("training", "epochs", "bigint", 100, "epochs", True),
    ("training", "workers", "bigint", 0, "workers", True),
    ("training", "device", "string", "mps", "device", True),
    ("training", "patience", "bigint", 50, "patience", True),
    ("training", "save_period", "bigint", 10, "save_period", True),
    ("training", "amp", "boolean", True, "amp", True),
    ("training", "half", "boolean", False, "half", True),
    ("training", "cache", "boolean", False, "cache", True),
    ("training", "multi_scale", "boolean", False, "multi_scale", True),
    ("training", "deterministic", "boolean", False, "deterministic", True),
    ("training", "optimizer", "string", "AdamW", "optimizer", True),
    ("training", "lr0", "double", 0.01, "lr0", True),
    ("training", "lrf", "double", 0.01, "lrf", True),
    ("training", "momentum", "double", 0.937, "momentum", True),
    ("training", "weight_decay", "double", 0.0005, "weight_decay", True),
    ("training", "warmup_epochs", "double", 3.0, "warmup_epochs", True),
    ("training", "warmup_momentum", "double", 0.8, "warmup_momentum", True),
    ("training", "warmup_bias_lr", "double", 0.1, "warmup_bias_lr", True),
    ("training", "hsv_h", "double", 0.015, "hsv_h", False),
    ("training", "hsv_s", "double", 0.7, "hsv_s", False),
    ("training", "hsv_v", "double", 0.4, "hsv_v", False),
    ("training", "degrees", "double", 0.0, "degrees", False),
    ("training", "translate", "double", 0.1, "translate", False),
    ("training", "scale", "double", 0.5, "scale", False),
    ("training", "shear", "double", 0.0, "shear", False),
    ("training", "perspective", "double", 0.0, "perspective", False),
    ("training", "flipud", "double", 0.0, "flipud", False),
    ("training", "fliplr", "double", 0.5, "fliplr", False),
    ("training", "mosaic", "double", 1.0, "mosaic", False),
    ("training", "mixup", "double", 0.0, "mixup", False),
    ("training", "copy_paste", "double", 0.0, "copy_paste", False),
    ("mps", "max_memory_fraction", "double", 0.8, None, True),
    ("mps", "empty_cache_frequency", "bigint", 10, None, True),
    ("mps", "torch_compile", "boolean", False, None, True),
    ("mps", "sync_bn", "boolean", False, None, True),
    ("mps", "use_cpu_fallback", "boolean", True, None, True),
    ("mps", "pin_memory", "boolean", False, None, True),
    ("mps", "persistent_workers", "boolean", False, None, True),
    ("prediction", "confidence_threshold", "double", 0.25, None, True),
    ("prediction", "iou_threshold", "double", 0.7, None, True),
    ("prediction", "max_detections", "bigint", 300, None, True),
    ("prediction", "half_precision", "boolean", False, None, True),
    ("prediction", "augment", "boolean", False, None, True),
    ("prediction", "agnostic_nms", "boolean", False, None, True),
    ("validation", "split", "string", "val", "split", False),
    ("validation", "save_json", "boolean", False, "save_json", False),
    ("validation", "save_hybrid", "boolean", False, "save_hybrid", False),
    ("validation", "single_cls", "boolean", False, "single_cls", False),
    ("validation", "rect", "boolean", False, "rect", False),
    ("logging", "verbose", "boolean", True, "verbose", False),
    ("logging", "plots", "boolean", True, "plots", False),
    ("logging", "tensorboard", "boolean", False, None, False),
    ("logging", "clearml", "boolean", False, None, False),
    ("logging", "comet", "boolean", False, None, False),
    ("environment", "profile", "boolean", False, "profile", False),
    ("environment", "debug", "boolean", False, None, False),
    ("environment", "seed", "bigint", 0, "seed", False),
    ("paths", "training_data", "string", "training_data", None, True),
    ("paths", "dataset_yaml", "string", "training_data/data.yaml", None, True),
    ("paths", "project", "string", "training_data/runs", None, True),
    ("paths", "output", "string", "../output", None, True),
)
#: What the preset forces.
PRESET = {"workers": 0, "batch_size": -1, "amp": True, "half": False, "cache": False, "pin_memory": False, "persistent_workers": False, "multi_scale": False, "deterministic": False}
#: The settings that the command line can give, by option.
OPTIONS = {"epochs": "epochs", "batch": "batch_size", "device": "device", "model": "architecture", "run_name": "run_name", "workers": "workers", "amp": "amp"}
#: Allowed values and ranges.
ALLOWED = {"architecture": ["yolo11n.pt", "yolo11s.pt", "yolo11m.pt", "yolo11l.pt", "yolo11x.pt"], "device": ["cpu", "mps", "cuda", "auto"], "optimizer": ["SGD", "Adam", "AdamW"]}
RANGES = {"batch_size": (-1, None), "epochs": (1, None), "workers": (0, 16), "max_memory_fraction": (0.1, 1.0), "empty_cache_frequency": (1, None)}

KINDS = {key: kind for _, key, kind, *_ in REGISTRY}


def resolve(profiles: DataFrame, sections_col: str = "sections") -> DataFrame:
    """profiles with one typed column for each setting, and `error`.

    A default stands in only where the key is absent; a key that is present with null stays null. An empty file and a
    section that is present but blank are errors. A value that its type can't hold becomes null.
    """
    s = F.col(sections_col)
    blank = F.coalesce(*[F.when(F.map_contains_key(s, F.lit(x)) & F.try_element_at(s, F.lit(x)).isNull(), F.lit(x)) for x in dict.fromkeys(x for x, *_ in REGISTRY)])
    columns = {key: present_or(F.try_element_at(s, F.lit(section)), key, F.lit(default).cast("string")).try_cast(kind) for section, key, kind, default, *_ in REGISTRY}
    error = F.when(s.isNull(), F.lit("the file is empty")).when(blank.isNotNull(), F.concat(F.lit("section "), blank, F.lit(" is blank")))
    return profiles.withColumns(columns | {"error": error})


def device_rules(settings: DataFrame, available: Column) -> DataFrame:
    """Rules of the mps device, in order: without the device fall back to cpu and stop; else no workers, no half
    precision, no pinned memory, and the fallback flag of the environment."""
    on = F.coalesce((F.col("device") == "mps") & available, F.lit(False))
    return settings.withColumns({
        "workers": F.when(on & (F.col("workers") > 0), F.lit(0)).otherwise(F.col("workers")).cast("bigint"),
        "half": F.when(on & F.col("half"), F.lit(False)).otherwise(F.col("half")),
        "pin_memory": F.when(on & F.col("pin_memory"), F.lit(False)).otherwise(F.col("pin_memory")),
        "fallback_flag": F.when(on, F.when(F.col("use_cpu_fallback"), "1").otherwise("0")),
        "device": F.when((F.col("device") == "mps") & ~available, F.lit("cpu")).otherwise(F.col("device")),
    })


def auto_device(mps: Column, cuda: Column) -> Column:
    return F.coalesce(F.when(mps, "mps"), F.when(cuda, "cuda"), F.lit("cpu"))


def device_report(available: Column, built: Column) -> Column:
    return F.when(available, "available").when(~built, "not built").otherwise("no device")


def apply_preset(settings: DataFrame, wanted: Column, cli_device: Column) -> DataFrame:
    """The preset's values where it is wanted and either the command line or the profile names mps."""
    on = F.coalesce(wanted & (F.coalesce(cli_device == "mps", F.lit(False)) | F.coalesce(F.col("device") == "mps", F.lit(False))), F.lit(False))
    return settings.withColumns({k: F.when(on, F.lit(v).cast(KINDS[k])).otherwise(F.col(k)) for k, v in PRESET.items()})


def override(settings: DataFrame, values: dict[str, Column]) -> DataFrame:
    """Values that are given (not null) win; names that are no setting are ignored."""
    return settings.withColumns({k: F.coalesce(v.cast(KINDS[k]), F.col(k)) for k, v in values.items() if k in KINDS})


def override_with_rules(settings: DataFrame, values: dict[str, Column], available: Column) -> DataFrame:
    """override(), whose names may be in any case, and then the device rules once more."""
    return device_rules(override(settings, {k.lower(): v for k, v in values.items()}), available)


def overlay(base: DataFrame, changes: DataFrame, key: str = "key", value: str = "value") -> DataFrame:
    """Merge of long tables: a change's value where it isn't null. Only the changes' keys and values move."""
    c = changes.select(F.col(key), F.col(value).alias("__changed"))
    return base.join(c, key, "left").withColumn(value, F.coalesce("__changed", value)).drop("__changed")


def overlay_layers(rows: DataFrame, null_wins: Column, key: str = "key", layer: str = "layer", order: str = "order", value: str = "value") -> DataFrame:
    """(key, layer, value) in force of any number of layers in one aggregation: the highest layer that gives the key, and
    in it the row with the highest order. Setting names are upper-cased, so `Epochs` and `EPOCHS` are one.

    A row counts as given if its value isn't null, or if null_wins (true for files, where a key that is present with null
    stays null, false for the command line, where null means not given). A key that nothing gives is left out.
    """
    given = F.col(value).isNotNull() | null_wins
    best = F.max(F.struct(F.col(layer).alias("layer"), F.col(order).alias("order"), F.col(value).alias("value")))
    return rows.filter(given).groupBy(F.upper(key).alias("key")).agg(best.alias("b")).select("key", "b.layer", "b.value")


def effective(profiles: DataFrame, cli: dict[str, Column] | None = None, available: Column | None = None, cuda: Column | None = None, preset: Column | None = None, faithful_amp: bool = True) -> DataFrame:
    """All layers in order: default < profile < device rules < preset < command line. The rules aren't run again.

    cli holds OPTIONS by name. With faithful_amp an amp that isn't given counts as false, as the option's two
    switches share one value whose default is false; without it, it counts as not given.
    """
    cli, available, cuda = dict(cli or {}), F.lit(False) if available is None else available, F.lit(False) if cuda is None else cuda
    device = cli.get("device", F.lit(None).cast("string"))
    cli["device"] = F.when(device == "auto", auto_device(available, cuda)).otherwise(device)
    if faithful_amp:
        cli["amp"] = F.coalesce(cli.get("amp", F.lit(None).cast("boolean")), F.lit(False))
    out = apply_preset(device_rules(resolve(profiles), available), F.lit(False) if preset is None else preset, cli["device"])
    return override(out, {OPTIONS[k]: v for k, v in cli.items() if k in OPTIONS})


def with_paths(settings: DataFrame, root: Column) -> DataFrame:
    """Add training_data_path, dataset_path, project_path, output_path, model_path and weights_path."""
    out = settings.withColumns({name: join_path(root, F.col(key)) for name, key in (("training_data_path", "training_data"), ("dataset_path", "dataset_yaml"), ("project_path", "project"), ("output_path", "output"))})
    weights = F.when(F.col("use_best_weights"), "best.pt").otherwise("last.pt")
    return out.withColumns({"model_path": join_path(F.col("training_data_path"), F.col("architecture")), "weights_path": F.concat_ws("/", join_path(F.col("project_path"), F.col("run_name")), F.lit("weights"), weights)})


def training_parameters(settings: DataFrame) -> DataFrame:
    """The 47 training parameters by their own names, from settings with paths."""
    own = [F.col(key).alias(name) for _, key, _, _, name, _ in REGISTRY if name]
    return settings.select(F.col("dataset_path").alias("data"), F.col("project_path").alias("project"), F.lit(True).alias("exist_ok"), F.lit(True).alias("val"), *own)


def snapshot(settings: DataFrame, complete: bool = False) -> DataFrame:
    """(profile_name, document): the settings as JSON by section. As it stands a snapshot loses 26 settings; complete keeps all."""
    sections: dict[str, list[Column]] = {}
    for section, key, _, _, _, saved in REGISTRY:
        if saved or complete:
            sections.setdefault(section, []).append(F.col(key))
    return settings.select("profile_name", F.to_json(F.struct(*[F.struct(*c).alias(s) for s, c in sections.items()]), {"ignoreNullFields": "false"}).alias("document"))


def violations(settings: DataFrame) -> DataFrame:
    """(profile_name, setting, value) that breaks an allowed list or a range."""
    checks = []
    for k, v in ALLOWED.items():
        checks.append(F.when(~F.col(k).isin(v), F.struct(F.lit(k).alias("setting"), F.col(k).alias("value"))))
    for k, (low, high) in RANGES.items():
        bad = F.col(k) < low
        if high is not None:
            bad |= F.col(k) > high
        checks.append(F.when(bad, F.struct(F.lit(k).alias("setting"), F.col(k).cast("string").alias("value"))))
    return settings.select("profile_name", F.explode(F.filter(F.array(*checks), lambda x: x.isNotNull())).alias("v")).select("profile_name", "v.*")
