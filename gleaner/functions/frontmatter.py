"""Frontmatter: YAML 1.2 core mappings as JSON, in Arrow batches."""

from __future__ import annotations

import json
import re

import pandas as pd
import yaml
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


class _Core(yaml.SafeLoader):
    """A loader that keeps what YAML 1.2 keeps as text: dates, yes and no, on and off, base-60 and old octal numbers."""


class _Fast(getattr(yaml, "CSafeLoader", yaml.SafeLoader)):
    """The same by libyaml, where it is installed."""


#: Texts that both loaders read alike: no tabs, tags, directives, block scalars, returns or unusual white space, and too short to nest deeper than the stack is.
_ALIKE = re.compile(r"[^\x00-\x09\x0B-\x1F!%>|\x7F-\x9F\u2028\u2029\uFEFF\uD800-\uDFFF\uFFFE\uFFFF]{0,4096}")
_Core.yaml_implicit_resolvers = _Fast.yaml_implicit_resolvers = {
    first: [(tag, pattern) for tag, pattern in found if tag not in ("tag:yaml.org,2002:timestamp", "tag:yaml.org,2002:bool", "tag:yaml.org,2002:int", "tag:yaml.org,2002:float")]
    for first, found in yaml.SafeLoader.yaml_implicit_resolvers.items()
}
_Core.add_implicit_resolver("tag:yaml.org,2002:bool", re.compile(r"^(?:true|True|TRUE|false|False|FALSE)$"), list("tTfF"))
_Core.add_implicit_resolver("tag:yaml.org,2002:int", re.compile(r"^(?:[-+]?(?:0|[1-9][0-9]*)|0o[0-7]+|0x[0-9a-fA-F]+)$"), list("-+0123456789"))
_Core.add_implicit_resolver("tag:yaml.org,2002:float", re.compile(r"^(?:[-+]?(?:\.[0-9]+|[0-9]+(?:\.[0-9]*)?)(?:[eE][-+]?[0-9]+)?|[-+]?\.(?:inf|Inf|INF)|\.(?:nan|NaN|NAN))$"), list("-+0123456789."))


def parse_yaml(text: str | None) -> str | None:
    """A YAML mapping as a JSON text; None if it is none, or no YAML."""
    if text is None:
        return None
    try:
        found = yaml.load(text, Loader=_Fast if _ALIKE.fullmatch(text) else _Core)
    except (yaml.YAMLError, ValueError):
        return None
    return json.dumps(found, ensure_ascii=False, default=str) if isinstance(found, dict) else None


@F.pandas_udf(StringType())
def yaml_to_json(texts: pd.Series) -> pd.Series:
    return texts.map(parse_yaml)
