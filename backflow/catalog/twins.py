"""SQL twins: named CTEs in the portable dialect and a resolver that prepends
the ones a query mentions."""

from __future__ import annotations

import re

from backflow.sources.order_lines import order_lines_twin

CTES: dict[str, str] = {}


def cte(name: str, sql: str) -> str:
    CTES[name] = sql
    return name


def twin(body: str) -> str:
    """``WITH`` every CTE the body needs, in dependency order, then the body."""
    done: list[str] = []
    active: set[str] = set()

    def visit(text: str) -> None:
        for name in CTES:
            if name in done or name in active or not re.search(rf"\b{name}\b", text):
                continue
            active.add(name)  # a recursive CTE mentions itself
            visit(CTES[name])
            done.append(name)

    visit(body)
    if not done:
        return body
    head = ",\n".join(f"{n} AS ({CTES[n].strip()})" for n in done)
    return f"WITH {head}\n{body.strip()}"


cte("order_lines", order_lines_twin())
