"""What is copied from where: a list of mappings in TOML, also as a small table."""

from __future__ import annotations

import json
import tomllib
from collections.abc import Iterable
from dataclasses import asdict, dataclass, fields

from pyspark.sql import DataFrame, SparkSession

MAPPING = "source_file string, source_var_name string, end_var_name string, target_module string, description string"


@dataclass(frozen=True)
class CopyMapping:
    source_file: str
    source_var_name: str
    target_module: str
    end_var_name: str | None = None
    description: str | None = None


class CopyMappings(tuple):
    """Mappings in the order of their file."""

    @classmethod
    def from_toml(cls, text: str) -> CopyMappings:
        known = {f.name for f in fields(CopyMapping)}
        return cls(CopyMapping(**{k: v for k, v in m.items() if k in known}) for m in tomllib.loads(text).get("mappings", []))

    def to_toml(self) -> str:
        def table(m: CopyMapping) -> Iterable[str]:
            yield "[[mappings]]"
            # A JSON string without characters beyond the basic plane's escapes is a TOML string.
            yield from (f"{k} = {json.dumps(v, ensure_ascii=False)}" for k, v in asdict(m).items() if v is not None)

        return "\n\n".join("\n".join(table(m)) for m in self) + "\n"

    def by_variable(self, name: str) -> CopyMapping | None:
        return next((m for m in self if m.source_var_name == name), None)

    def by_target(self, module: str) -> CopyMapping | None:
        return next((m for m in self if m.target_module == module), None)

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(m.source_file, m.source_var_name, m.end_var_name, m.target_module, m.description) for m in self], MAPPING)
