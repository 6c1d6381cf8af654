"""Environment values for graphs: providers in order, scopes of subgraphs, and templates."""

from __future__ import annotations

import os
import re
from collections.abc import Mapping

# Fixed values: ${KEY}, ${KEY:-default}, ${KEY:?message}, {{KEY}}, and $${ for a literal ${
_TEMPLATE = re.compile(r"\$\$\{|\$\{(\w+)(?::([-?])([^}]*))?\}|\{\{\s*(\w+)\s*\}\}")


class Env:
    """The first provider that has a key wins. Inside a subgraph, keys with its upper-case name in front come first."""

    def __init__(self, *providers: Mapping[str, str], scopes: tuple[str, ...] = ()):
        self.providers, self.scopes = providers, scopes

    @classmethod
    def of_process(cls, dotenv: str | None = None) -> Env:
        return cls(os.environ, *([read_dotenv(dotenv)] if dotenv else []))

    def scoped(self, name: str) -> Env:
        return Env(*self.providers, scopes=(re.sub(r"\W", "_", name).upper(), *self.scopes))

    def get(self, key: str) -> str | None:
        for full in [*(f"{s}_{key}" for s in self.scopes), key]:
            for p in self.providers:
                if full in p:
                    return p[full]
        return None

    def all(self) -> dict[str, str]:
        out: dict[str, str] = {}
        for p in reversed(self.providers):
            out |= p
        return dict(sorted(out.items()))

    def resolve(self, template: str) -> str:
        """A missing plain key is empty; ${K:?m} raises m."""

        def one(m: re.Match) -> str:
            if m[0] == "$${":
                return "${"
            value = self.get(m[1] or m[4])
            if value is None and m[2] == "?":
                raise KeyError(m[3] or f"{m[1]} is not set")
            return value if value is not None else m[3] or "" if m[2] == "-" else ""

        return _TEMPLATE.sub(one, template)


def template_keys(template: str) -> dict[str, bool]:
    """Keys that a template reads; True for those with a default."""
    return {m[1] or m[4]: m[2] == "-" for m in _TEMPLATE.finditer(template) if m[0] != "$${"}


def read_dotenv(path: str) -> dict[str, str]:
    out = {}
    with open(path, encoding="utf-8") as f:
        for line in f:
            line = line.strip().removeprefix("export ")
            if line and not line.startswith("#") and "=" in line:
                k, v = line.split("=", 1)
                v = v.strip()
                out[k.strip()] = v[1:-1] if len(v) > 1 and v[0] == v[-1] and v[0] in "\"'" else v.split(" #")[0].rstrip()
    return out
