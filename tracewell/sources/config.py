"""Checks of a domain's configuration, made on the driver before any job starts."""

from __future__ import annotations

REQUIRED = ("domain", "display_name", "csv_path", "columns")
REQUIRED_ROLES = ("method.name",)


class ConfigError(ValueError):
    """What is wrong with a configuration."""


def columns_by_role(config: dict, roles: set[str] | None = None, facets: tuple[str, ...] = ()) -> dict[str, list[str]]:
    """Role -> columns that play it, in their order; raises where keys or roles are missing, unknown, or a facet names no role's column."""
    missing = [k for k in REQUIRED if not config.get(k)]
    if missing:
        raise ConfigError(f"missing {', '.join(missing)}")
    if not isinstance(config["columns"], dict):
        raise ConfigError("columns must map names to roles")
    found: dict[str, list[str]] = {}
    for column, spec in config["columns"].items():
        if role := (spec or {}).get("role"):
            if roles is not None and role not in roles:
                raise ConfigError(f"column {column!r} has the unknown role {role!r}")
            found.setdefault(role, []).append(column)
    if lacking := [r for r in REQUIRED_ROLES if r not in found]:
        raise ConfigError(f"no column has the role {', '.join(lacking)}")
    if unknown := [f for f in config.get("facets", ()) if f not in (facets or found)]:
        raise ConfigError(f"unknown facets {', '.join(unknown)}")
    return found
