"""JSON documents: factors with the macros they need, formula families, sessions and their checkpoints."""

from __future__ import annotations

import json
import re
import shutil
from dataclasses import dataclass
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import SparkSession

from . import files
from ..plans.expr import CATEGORIES, ExprError, Node, Registry, from_dict, parse, to_dict


def slug(name: str) -> str:
    return re.sub(r"[^a-z0-9_]+", "_", name.strip().lower()).strip("_")


def macro_dict(registry: Registry, name: str) -> dict:
    m = registry.macros[name]
    return {"name": name, "args": list(m.args), "out": m.out, "category": m.category, "body": to_dict(m.body)}


@dataclass
class Documents:
    """A folder of JSON documents on the driver's file system."""

    folder: Path

    def __post_init__(self) -> None:
        self.folder = Path(self.folder)
        self.folder.mkdir(parents=True, exist_ok=True)

    def _path(self, key: str) -> Path:
        if not (k := slug(key)):
            raise ValueError("a document needs a name")
        return self.folder / f"{k}.json"

    def put(self, key: str, data: dict) -> None:
        tmp = self._path(key).with_suffix(".tmp")
        tmp.write_text(json.dumps(data, sort_keys=True, indent=1))
        tmp.replace(self._path(key))

    def get(self, key: str) -> dict:
        return json.loads(self._path(key).read_text())

    def delete(self, key: str) -> bool:
        there = self._path(key).exists()
        self._path(key).unlink(missing_ok=True)
        return there

    def keys(self) -> list[str]:
        return sorted(p.stem for p in self.folder.glob("*.json"))

    def usage(self) -> dict[str, int]:
        files = list(self.folder.glob("*.json"))
        return {"files": len(files), "bytes": sum(p.stat().st_size for p in files)}

    def clear(self) -> int:
        return sum(self.delete(k) for k in self.keys())


@dataclass
class FactorStore:
    """Saved factors. Each carries the macros that its tree needs, so that it loads anywhere."""

    documents: Documents

    def save(self, name: str, tree: Node, registry: Registry, **meta) -> dict:
        registry.validate(tree)
        doc = {"name": name, "tree": to_dict(tree), "expanded": to_dict(registry.expand(tree)), "operators": [macro_dict(registry, m) for m in registry.required(tree)], "saved_at": datetime.now(UTC).isoformat(), **meta}
        self.documents.put(name, doc)
        return doc

    def load(self, name: str, registry: Registry) -> Node:
        doc = self.documents.get(name)
        for m in doc["operators"]:
            registry.ensure(m["name"], tuple(m["args"]), m["out"], from_dict(m["body"]), m["category"])
        return registry.validate(from_dict(doc["tree"]))

    def update(self, name: str, new_name: str | None = None, notes: str | None = None) -> dict | None:
        """Renames a factor or changes its notes; None if there is none."""
        if slug(name) not in self.documents.keys():
            return None
        doc = self.documents.get(name)
        if notes is not None:
            doc["notes"] = notes
        if new_name is not None and slug(new_name) != slug(name):
            if slug(new_name) in self.documents.keys():
                raise ValueError(f"a factor {new_name!r} is there")
            doc["name"] = new_name
            self.documents.put(new_name, doc)
            self.documents.delete(name)
        else:
            doc["name"] = new_name or doc["name"]
            self.documents.put(name, doc)
        return doc

    def list(self) -> list[dict]:
        """The latest first."""
        return sorted((self.documents.get(k) for k in self.documents.keys()), key=lambda d: d.get("saved_at", ""), reverse=True)

    def delete(self, name: str) -> bool:
        return self.documents.delete(name)


@dataclass
class FormulaStore:
    """Formula families in versions: a revision n above 1 registers as ``name__rn``; others may build on it."""

    documents: Documents
    registry: Registry

    @staticmethod
    def runtime_name(name: str, revision: int) -> str:
        return name if revision == 1 else f"{name}__r{revision}"

    def save(self, name: str, args: tuple[str, ...], out: str, body: Node, category: str = "custom") -> str:
        name = slug(name)
        doc = self.documents.get(name) if name in self.documents.keys() else {"name": name, "revisions": []}
        revision = len(doc["revisions"]) + 1
        runtime = self.runtime_name(name, revision)
        self.registry.register(runtime, args, out, body, category)
        doc["revisions"].append({**macro_dict(self.registry, runtime), "family": name})
        self.documents.put(name, doc)
        return runtime

    def _all(self) -> dict[str, dict]:
        return {m["name"]: m for k in self.documents.keys() for m in self.documents.get(k)["revisions"]}

    def reload(self) -> list[str]:
        """Registers all, those that others need first."""
        todo, done = self._all(), []
        while todo:
            ready = [n for n, m in todo.items() if not ({x.name for x in from_dict(m["body"])} & set(todo))]
            if not ready:
                raise ExprError(f"formulas need each other: {sorted(todo)}")
            for n in sorted(ready):
                m = todo.pop(n)
                self.registry.ensure(n, tuple(m["args"]), m["out"], from_dict(m["body"]), m["category"])
                done.append(n)
        return done

    def validate(self, text: str, args: tuple[str, ...] = ()) -> dict:
        """Whether a formula's text can be read and typed, without saving it: its type, or what is wrong."""
        try:
            return {"valid": True, "type": self.registry.infer(parse(text, self.registry), args), "error": None}
        except ExprError as e:
            return {"valid": False, "type": None, "error": str(e)}

    def impact(self, runtime: str, factors: FactorStore | None = None, sessions: Documents | None = None) -> dict[str, list[str]]:
        """What needs a formula: directly, through others, saved factors, and sessions."""
        uses = {n: {x.name for x in from_dict(m["body"])} for n, m in self._all().items()}
        direct = sorted(n for n, u in uses.items() if runtime in u)
        reach, todo = set(direct), list(direct)
        while todo:
            at = todo.pop()
            new = {n for n, u in uses.items() if at in u} - reach
            reach |= new
            todo += new
        named = [d["name"] for d in factors.list() if runtime in {m["name"] for m in d["operators"]}] if factors else []
        held = [k for k in sessions.keys() if ({runtime} | reach) & set(sessions.get(k).get("operators", []))] if sessions else []
        return {"direct": direct, "transitive": sorted(reach - set(direct)), "factors": named, "sessions": held}

    def upgrade(self, old: str, new: str, only: set[str] | None = None) -> list[str]:
        """Formulas that use ``old`` (``only`` some of them) get a revision that uses ``new``; undone as a whole if
        one doesn't fit."""
        made: list[tuple[str, str]] = []
        try:
            for n in (x for x in self.impact(old)["direct"] if only is None or x in only):
                m = self._all()[n]
                swap = lambda x: Node(new if x.name == old else x.name, tuple(map(swap, x.children)), x.value)
                family = m["family"]
                made.append((family, self.save(family, tuple(m["args"]), m["out"], swap(from_dict(m["body"])), m["category"])))
        except ExprError:
            for family, runtime in reversed(made):
                doc = self.documents.get(family)
                doc["revisions"].pop()
                self.documents.put(family, doc)
                self.registry.unregister(runtime)
            raise
        return [r for _, r in made]

    def delete(self, name: str, factors: FactorStore | None = None, sessions: Documents | None = None) -> bool:
        for m in self.documents.get(name)["revisions"]:
            found = self.impact(m["name"], factors, sessions)
            if found["direct"] or found["factors"] or found["sessions"]:
                raise ExprError(f"{m['name']} is in use: {found}")
        for m in self.documents.get(name)["revisions"]:
            self.registry.unregister(m["name"])
        return self.documents.delete(name)


#: Folders of a data home by category.
FOLDERS = {"prices": "prices", "universes": "universe", "sessions": "sessions", "factors": "factors", "workspaces": "workspaces", "lineage": "lineage"}


def usage(home: Path | str, spark: SparkSession | None = None) -> dict[str, dict[str, int]]:
    """Files and bytes of each category of a data home: on the driver's file system, or with a session on
    whatever file system ``home`` names."""
    out = {}
    for key, folder in FOLDERS.items():
        if spark:
            size, count = files.size(spark, f"{str(home).rstrip('/')}/{folder}")
        else:
            own = [p for p in (Path(home) / folder).rglob("*") if p.is_file()]
            size, count = sum(p.stat().st_size for p in own), len(own)
        out[key] = {"files": count, "bytes": size}
    return out


def clear(home: Path | str, category: str, spark: SparkSession | None = None) -> None:
    """Empties one category's folder."""
    if category not in FOLDERS:
        raise ValueError(f"unknown category {category!r}")
    if spark:
        files.remove(spark, f"{str(home).rstrip('/')}/{FOLDERS[category]}")
        return
    folder = Path(home) / FOLDERS[category]
    shutil.rmtree(folder, ignore_errors=True)
    folder.mkdir(parents=True)


@dataclass
class Categories:
    """Categories in their order and overrides by operator, kept in a document; an override goes before a macro's
    own category, and that before the built-in one."""

    documents: Documents

    def state(self) -> dict:
        return self.documents.get("categories") if "categories" in self.documents.keys() else {"order": list(CATEGORIES), "overrides": {}}

    def add(self, name: str) -> dict:
        state = self.state()
        if not slug(name) or slug(name) in state["order"]:
            raise ValueError(f"category {name!r} is there, or has no name")
        state["order"].append(slug(name))
        self.documents.put("categories", state)
        return state

    def remove(self, name: str) -> dict:
        """Takes out a category that isn't built in, and its overrides."""
        state = self.state()
        if name in CATEGORIES or name not in state["order"]:
            raise ValueError(f"category {name!r} can't be removed")
        state["order"].remove(name)
        state["overrides"] = {k: v for k, v in state["overrides"].items() if v != name}
        self.documents.put("categories", state)
        return state

    def assign(self, operator: str, category: str | None, registry: Registry) -> dict:
        """Overrides an operator's category, or takes the override back."""
        state = self.state()
        registry.category(operator)  # raises for an unknown one
        if category is None:
            state["overrides"].pop(operator, None)
        elif category in state["order"]:
            state["overrides"][operator] = category
        else:
            raise ValueError(f"unknown category {category!r}")
        self.documents.put("categories", state)
        return self.apply(registry)

    def apply(self, registry: Registry) -> dict:
        """Gives the overrides to a registry."""
        state = self.state()
        registry.overrides.clear()
        registry.overrides.update(state["overrides"])
        return state


@dataclass
class Settings:
    """Settings in a document: where factors are kept, and a provider's key, which is never shown."""

    documents: Documents

    def _state(self) -> dict:
        return self.documents.get("settings") if "settings" in self.documents.keys() else {}

    def show(self) -> dict:
        state = self._state()
        return {"factors_dir": state.get("factors_dir", FOLDERS["factors"]), "provider_key_set": "provider_key" in state}

    def provider_key(self) -> str | None:
        return self._state().get("provider_key")

    def update(self, changes: dict) -> dict:
        """Changes some settings and leaves the others; an empty key takes the stored one away. Raises for what
        isn't a setting, and for a folder that can't be made; then nothing changes."""
        state = self._state()
        for name, value in changes.items():
            if name not in ("factors_dir", "provider_key") or not isinstance(value, str):
                raise ValueError(f"not a setting: {name!r} = {value!r}")
        if folder := changes.get("factors_dir"):
            try:
                Path(folder).expanduser().mkdir(parents=True, exist_ok=True)
            except OSError as e:
                raise ValueError(f"factors_dir can't be used: {e}") from e
            state["factors_dir"] = str(Path(folder).expanduser())
        if (key := changes.get("provider_key")) is not None:
            state |= {"provider_key": key.strip()}
            if not key.strip():
                del state["provider_key"]
        self.documents.put("settings", state)
        return self.show()


#: What a workspace may hold, by type; the first three it must.
WORKSPACE = {"name": str, "version": int, "savedAt": str, "run": dict, "universes": list, "operators": list, "universeDraft": dict, "formulaDraft": dict, "operatorDraft": dict, "ui": dict}


@dataclass
class Workspaces:
    """Saved states of a user's work, a document each."""

    documents: Documents

    def save(self, data: dict) -> str:
        """Stores a workspace by its name; raises where a part is missing or of another type."""
        wrong = [k for k in list(WORKSPACE)[:3] if data.get(k) is None] + [k for k, v in data.items() if v is not None and not isinstance(v, WORKSPACE.get(k, ()))]
        if wrong or data["version"] < 1:
            raise ValueError(f"not a workspace: {wrong or ['version']}")
        self.documents.put(data["name"], data)
        return slug(data["name"])

    def get(self, key: str) -> dict:
        if slug(key) not in self.documents.keys():
            raise KeyError(key)
        return self.documents.get(key)

    def delete(self, key: str) -> bool:
        return self.documents.delete(key)

    def summaries(self) -> list[dict]:
        """Those saved last come first."""
        rows = [(k, self.documents.get(k)) for k in self.documents.keys()]
        return [{"id": k, "name": d["name"], "savedAt": d["savedAt"], "hasRun": d.get("run") is not None} for k, d in sorted(rows, key=lambda r: r[1]["savedAt"], reverse=True)]
