"""Expectations about a graph, as fixtures state them: rows that must, or must not, be there.

A row of a category (entities, relationships, aliases, episode_entity_mentions,
episode_relationship_mentions) meets an expectation if each field that the expectation names does:
by equality (null too, where the field may be null), by containment without regard to case
(`..._contains`), or by a pattern with % for any text (`..._like`).
"""

import re

#: Fields whose value may be asked to be null; others are compared only if they are given.
NULLABLE = {"valid_at", "invalid_at", "relationship_id"}
#: Other names of a check.
SHORT = {"target": "target_entity_name_contains", "name_contains": "canonical_name_contains", "name": "canonical_name"}


def like(value: str, pattern: str) -> bool:
    return re.fullmatch(".*".join(map(re.escape, pattern.split("%"))), value, re.S) is not None


def _meets(row: dict, field: str, wanted) -> bool:
    field = SHORT.get(field, field)
    if wanted is None:
        return field not in NULLABLE or row.get(field) is None
    if field == "entity_type":
        return wanted == "any" or str(row.get(field)).lower() == str(wanted).lower()
    for ending, test in (("_contains", lambda have: wanted.lower() in have.lower()), ("_like", lambda have: like(have, wanted))):
        if field.endswith(ending):
            have = row.get(field.removesuffix(ending))
            return have is not None and test(have)
    return row.get(field) == wanted


def found(expected: dict, rows: list[dict]) -> bool:
    return any(all(_meets(row, f, w) for f, w in expected.items()) for row in rows)


def failures(expectations: dict[str, dict[str, list[dict]]], graph: dict[str, list[dict]]) -> list[tuple[str, str, dict]]:
    """(category, must_have or must_not_have, expectation) of all that fail; optional ones never do."""
    out = []
    for category, group in expectations.items():
        rows = graph.get(category, [])
        out += [(category, "must_have", e) for e in group.get("must_have", []) if not found(e, rows)]
        out += [(category, "must_not_have", e) for e in group.get("must_not_have", []) if found(e, rows)]
    return out


def graph_rows(state: dict) -> dict[str, list[dict]]:
    """The rows of a graph's tables with the names that expectations speak of."""
    from tidemark.operators.graph import ENTITY_TYPES

    kinds = dict(ENTITY_TYPES)
    rows = lambda n: [r.asDict() for r in state[n].collect()]
    entities = rows("entities")
    name = {e["entity_id"]: e["canonical_name"] for e in entities}
    return {
        "entities": [e | {"entity_type": kinds[e["entity_type_id"]]} for e in entities if e["merged_into"] is None],
        "relationships": [r | {"source_entity_name": name.get(r["source_entity_id"]), "target_entity_name": name.get(r["target_entity_id"])} for r in rows("relationships")],
        "aliases": [a | {"entity_name": name.get(a["entity_id"])} for a in rows("aliases")],
        "episode_entity_mentions": [m | {"entity_name": name.get(m["entity_id"])} for m in rows("entity_mentions")],
        "episode_relationship_mentions": rows("relationship_mentions"),
    }
