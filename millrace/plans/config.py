"""Settings of a replication, from the nested mapping that a YAML or JSON file gives."""

from __future__ import annotations

from dataclasses import dataclass, field

from millrace.operators.filters import Replicate


def _list(x) -> tuple[str, ...]:
    """A list, or comma-separated text."""
    parts = x.split(",") if isinstance(x, str) else (x or ())
    return tuple(p.strip() for p in parts if p and p.strip())


@dataclass(frozen=True)
class Destination:
    """insert: insert or replace; update: update or replace. max_count, max_delay: when pending commits are flushed at the latest."""

    name: str
    rule: Replicate = Replicate()
    gtidset: str = ""
    max_count: int = 1
    max_delay: int = 1
    insert: str = "insert"
    update: str = "update"

    @classmethod
    def of(cls, name: str, settings: dict) -> Destination:
        sync = settings.get("sync") or {}
        rule, commit, mode = sync.get("replicate") or {}, sync.get("merge_commit") or {}, sync.get("dml_mode") or {}
        out = cls(
            name, Replicate(_list(rule.get("do_db")), _list(rule.get("ignore_db")), _list(rule.get("do_table")), _list(rule.get("ignore_tab"))),
            sync.get("gtidsets") or "", max(1, int(commit.get("max_count", 1))), max(1, int(commit.get("max_delay", 1))),
            mode.get("insert", "insert"), mode.get("update", "update"),
        )
        if out.insert not in ("insert", "replace") or out.update not in ("update", "replace"):
            raise ValueError(f"{name}: no such mode: {out.insert}, {out.update}")
        return out


@dataclass(frozen=True)
class Settings:
    name: str = ""
    files_at_once: int = 1000
    destinations: dict[str, Destination] = field(default_factory=dict)

    @classmethod
    def of(cls, settings: dict) -> Settings:
        source, sinks = settings.get("replication") or {}, (settings.get("destination") or {}).get("destinations") or {}
        cache = int((source.get("settings") or {}).get("cache", 1000))
        return cls(source.get("name", ""), max(1000, cache), {k: Destination.of(k, v or {}) for k, v in sinks.items()})
