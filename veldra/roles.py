"""Column roles from header files, and columns by name or position."""

from __future__ import annotations

from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import types as T

#: The words for roles; ignored and id are recognised by their beginning.
SYMBOLIC_WORDS = ("symbolic", "categorical", "nominal", "string")
NUMERIC_WORDS = ("numeric", "continuous", "real", "double")
NUMBERS = (T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


@dataclass
class Header:
    """Names and roles (``id``, ``ignored``, ``numeric``, ``symbolic``) of columns in order."""

    names: list[str]
    roles: list[str]

    @classmethod
    def parse(cls, text: str) -> Header:
        """Lines ``name,role``; a bare name is numeric, blank lines are skipped."""
        names, roles = [], []
        for line in text.splitlines():
            if not line.strip():
                continue
            pieces = [p.strip() for p in line.split(",")]
            if len(pieces) > 2:
                raise ValueError(f"a header line has a name and a role: {line}")
            names.append(pieces[0])
            roles.append(_role(pieces[1]) if len(pieces) == 2 else "numeric")
        if roles.count("id") > 1:
            raise ValueError("a header has one id column at most")
        return cls(names, roles)

    @classmethod
    def load(cls, path: str) -> Header:
        return cls.parse(Path(path).read_text())

    @classmethod
    def of_schema(cls, schema: T.StructType) -> Header:
        return cls(schema.names, ["numeric" if is_numeric(f.dataType) else "symbolic" for f in schema])

    def text(self) -> str:
        return "".join(f"{n},{r}\n" for n, r in zip(self.names, self.roles))

    def save(self, path: str) -> None:
        Path(path).write_text(self.text())

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(n, T.DoubleType() if r == "numeric" else T.StringType()) for n, r in zip(self.names, self.roles)])

    def columns(self, *roles: str) -> list[str]:
        return [n for n, r in zip(self.names, self.roles) if r in roles]

    @property
    def id_column(self) -> str | None:
        return next(iter(self.columns("id")), None)


def _role(word: str) -> str:
    w = word.lower()
    if w.startswith("ignore"):
        return "ignored"
    if w.startswith("id"):
        return "id"
    if w in SYMBOLIC_WORDS:
        return "symbolic"
    if w in NUMERIC_WORDS:
        return "numeric"
    raise ValueError(f"unknown role {word}")


def is_numeric(kind: T.DataType) -> bool:
    return isinstance(kind, NUMBERS)


def resolve(columns: list[str], wanted: str | list[str]) -> list[str]:
    """Columns by name, or by position if the first isn't a name. An unknown one is an error."""
    items = [w.strip() for w in wanted.split(",")] if isinstance(wanted, str) else list(wanted)
    if not items or items[0] in columns:
        found = items
    elif all(str(i).isdigit() and int(i) < len(columns) for i in items):
        found = [columns[int(i)] for i in items]
    else:
        found = items
    if missing := [c for c in found if c not in columns]:
        raise ValueError(f"unknown columns: {', '.join(missing)}")
    return found
