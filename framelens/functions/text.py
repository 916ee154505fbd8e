"""Expressions over names, paths and titles of artifacts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from framelens.functions import fixed


def sanitize_token(raw: Column) -> Column:
    kept = F.regexp_replace(F.trim(raw), fixed.TOKEN_FORBIDDEN_PATTERN, "_")
    edged = F.regexp_replace(kept, fixed.TOKEN_EDGE_PATTERN, "")
    return F.coalesce(F.nullif(edged, F.lit("")), F.lit(fixed.UNKNOWN_TOKEN))


def artifact_id(suite: Column, version: Column, checkpoint: Column, label: Column) -> Column:
    def optional(part: Column) -> Column:
        return F.when(F.coalesce(part, F.lit("")) != "", sanitize_token(part))

    return F.concat_ws("__", sanitize_token(suite), sanitize_token(version), optional(checkpoint), optional(label))


def _parent(path: Column) -> Column:
    return F.regexp_replace(path, "/[^/]*$", "")


def _name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def checkpoint_columns(path: Column, wrapper_level: str) -> dict[str, Column]:
    """Checkpoint directory, step, run and id of a checkpoint path; nulls for a null path.

    ``wrapper_level`` names the directory that a training framework may put between a run
    and its checkpoints; it is skipped when the run is named. Repeated and closing slashes and
    ``.`` steps do not count.
    """
    clean = F.regexp_replace(F.regexp_replace(path, "/(\\./)+|/+", "/"), "(?<=.)(/\\.?)+$", "")
    directory = F.when(_name(clean) == "pretrained_model", _parent(clean)).otherwise(clean)
    step = F.when(_name(directory).rlike("^[0-9]+$"), _name(directory))
    in_run = _name(_parent(directory)) == "checkpoints"
    container = _parent(_parent(directory))
    run = F.when(in_run & (_name(container) == wrapper_level), _parent(container)).when(in_run, container)
    run_name = _name(run)
    joined = F.concat_ws(
        "__", F.when(run_name.isNotNull(), sanitize_token(run_name)), F.when(step.isNotNull(), sanitize_token(step))
    )
    identity = F.when(joined != "", joined).otherwise(sanitize_token(_name(directory)))
    return {
        "source_checkpoint_id": F.when(path.isNotNull(), identity),
        "source_checkpoint_path": path,
        "source_checkpoint_dir": F.when(path.isNotNull(), directory),
        "source_checkpoint_step": step,
        "source_run_name": run_name,
        "source_run_path": run,
    }


def registry_location(candidates: list[Column], marker: str, override: str | None = None) -> Column:
    """Registry file below the deepest ``marker`` directory of the first path that has one.

    An explicit override (a file chosen by the operator of the job) wins over all paths.
    """
    if override:
        return F.lit(override)

    def root(path: Column) -> Column:
        return F.nullif(F.regexp_extract(path, f"^(.*/{marker})(/.*)?$", 1), F.lit(""))

    return F.concat(F.coalesce(*[root(c) for c in candidates]), F.lit("/" + fixed.REGISTRY_RELATIVE_PATH))


def utc_text(ts: Column) -> Column:
    """Second-precision ISO text of a UTC timestamp (timestamp_ntz or UTC session)."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def sample_title(episode: Column, frame: Column, index: Column) -> Column:
    def part(word: str, value: Column) -> Column:
        return F.when(value.isNotNull(), F.concat(F.lit(word + " "), value.cast("bigint").cast("string")))

    joined = F.concat_ws(" | ", part("ep", episode), part("frame", frame), part("idx", index))
    return F.when(joined == "", F.lit("sample")).otherwise(joined)


def lookup(key: Column, table: dict[str, str], default: Column | None = None) -> Column:
    """Value of a small fixed map, else the default (the key itself when none is given)."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), key if default is None else default)


def display_name(latent_format: Column) -> Column:
    return lookup(latent_format, fixed.FORMAT_DISPLAY_NAMES)


def representation_name(latent_format: Column) -> Column:
    return lookup(latent_format, fixed.FORMAT_REPRESENTATIONS)
