"""A workspace's collections: where their files are, which of them count, and who parses them."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field
from pathlib import Path

from corvine.functions.globs import FileFilter

try:
    import yaml
except ImportError:  # then the file is JSON, which YAML readers understand too
    yaml = None

DEFAULT = "default"


@dataclass
class Collection:
    path: str = "."
    parsers: dict[str, str] = field(default_factory=dict)
    files: list[str] = field(default_factory=list)
    include: list[str] = field(default_factory=list)
    exclude: list[str] = field(default_factory=list)

    def filter(self) -> FileFilter:
        return FileFilter(list(self.files), list(self.include), list(self.exclude))


@dataclass
class Config:
    """The default collection is always there and starts at the workspace's root."""

    collections: dict[str, Collection] = field(default_factory=dict)

    def __post_init__(self) -> None:
        own = self.collections.setdefault(DEFAULT, Collection())
        own.path = "."

    def collection(self, name: str | None) -> Collection:
        name = name or DEFAULT
        if name not in self.collections:
            raise KeyError(f"no collection {name!r}; there are {', '.join(sorted(self.collections))}")
        return self.collections[name]

    @classmethod
    def parse(cls, text: str) -> Config:
        data = (yaml.safe_load(text) if yaml else json.loads(text)) if text.strip() else {}
        if not isinstance(data, dict):
            raise ValueError("a configuration is a mapping")
        known = Collection.__dataclass_fields__
        return cls({str(n): Collection(**{k: v for k, v in (c or {}).items() if k in known and v is not None}) for n, c in (data.get("collections") or {}).items()})

    def dump(self) -> str:
        """Without empty lists, and without the default collection's path."""
        out = {n: {k: v for k, v in asdict(c).items() if v and not (n == DEFAULT and k == "path")} for n, c in self.collections.items()}
        return yaml.safe_dump({"collections": out}, sort_keys=True) if yaml else json.dumps({"collections": out}, indent=2)

    @classmethod
    def load(cls, path: Path) -> Config:
        return cls.parse(path.read_text()) if path.exists() else cls()

    def save(self, path: Path) -> None:
        path.write_text(self.dump())
