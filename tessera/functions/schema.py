"""Validity of relative paths and names by the naming standard's vocabularies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera import config

_LABEL = "[a-zA-Z0-9]+"
_SUB, _SES = f"sub-{_LABEL}", f"ses-{_LABEL}"


def path_pattern() -> str:
    """One expression of all valid relative paths: files of a datatype, scans and sessions tables, and files of the root."""
    types = "|".join(config.DATATYPES)
    data = f"{_SUB}(?:/{_SES})?/(?:{types})/{_SUB}(?:_{_SES})?(?:_[a-z]+-{_LABEL})*_{_LABEL}\\.[a-zA-Z0-9.]+"
    scans = f"{_SUB}(?:/{_SES})?/{_SUB}(?:_{_SES})?_scans\\.tsv"
    sessions = f"{_SUB}/{_SUB}_sessions\\.tsv"
    root = f"participants\\.tsv|README[^/]*|CHANGES|LICENSE|(?:task-{_LABEL}_)?(?:acq-{_LABEL}_)?{_LABEL}\\.json|dataset_description\\.json"
    return f"^/*(?:{data}|{scans}|{sessions}|{root})$"


def is_valid(relative: Column) -> Column:
    """Whether a path under the root follows the standard; leading slashes don't count."""
    return relative.rlike(path_pattern())


def is_datatype(name: Column) -> Column:
    """One of the datatypes."""
    return name.isin(*config.DATATYPES)


def is_suffix(name: Column) -> Column:
    """One of the suffixes."""
    return name.isin(*config.SUFFIXES)


def is_extension(name: Column) -> Column:
    """One of the extensions."""
    return name.isin(*config.EXTENSIONS)


def entity_pattern(name: str) -> str | None:
    """The expression whose first group is an entity's value; None for unknown ones."""
    return dict(config.ENTITIES + config.DERIVATIVE_ENTITIES).get(name)
