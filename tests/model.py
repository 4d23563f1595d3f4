"""Plain recursive models of the rules, for small inputs. Schemas and values are Python data."""

from __future__ import annotations

from itertools import chain
from math import prod

SORTS = {str: "string", bool: "boolean", int: "number", float: "number", type(None): "null"}
SORTS |= {dict: "object", list: "array"}


def options(s):
    return s.get("anyOf", s.get("oneOf"))


def holds(s, v):
    if options(s) is not None:
        return any(holds(b, v) for b in options(s))
    sort = s["type"].replace("integer", "number")
    if SORTS[type(v)] != sort:
        return False
    if sort == "array" and v:
        fits = len(v) <= s.get("maxItems", s.get("maxProperties", len(v)))
        return fits and all(holds(s["items"], x) for x in v if "items" in s)
    if sort == "object":
        is_open = s.get("additionalProperties", False)
        complete = is_open or all(k in v for k in s.get("required", ()))
        return complete and members_hold(s, v)
    return True


def members_hold(s, v):
    if "properties" not in s:
        return not v
    is_open = s.get("additionalProperties", False)
    known = s["properties"]
    return all(holds(known[k], x) if k in known else is_open for k, x in v.items())


def leaves(path, v):
    if isinstance(v, dict) and v:
        return set().union(*(leaves(f"{path}.{k}", x) for k, x in v.items()))
    if isinstance(v, list) and v:
        return set().union(*(leaves(path + "[*]", x) for x in v))
    return {path}


def missing(s, v, path="$"):
    if options(s) is not None:
        return set(chain.from_iterable(missing(b, v, path) for b in options(s)))
    found = set()
    if isinstance(v, dict):
        known = s.get("properties", {})
        for k, x in v.items():
            if k in known:
                found |= missing(known[k], x, f"{path}.{k}")
            elif not s.get("additionalProperties", False) and not members_hold(s, v):
                found |= leaves(f"{path}.{k}", x)
    elif isinstance(v, list) and "items" in s:
        for x in v:
            found |= missing(s["items"], x, path + "[*]")
    return found


def charge(s, v):
    """Entity and paths of a failing value."""
    per = [missing(b, v) for b in s.get("anyOf", [s])]
    idx = min(range(len(per)), key=lambda i: (max(len(per[i]), 1), i))
    return idx, per[idx]


def precision(s, name=(), seen=None):
    seen = set() if seen is None else seen
    if options(s) is not None:
        return sum(precision(b, name, seen) for b in options(s))
    if "items" in s:
        return precision(s["items"], name, seen)
    if s.get("additionalProperties", False):
        if name in seen:
            return 1
        seen.add(name)
    factors = []
    # Node tables hold properties by key, so the model visits them by key as well.
    for k, inner in sorted(s.get("properties", {}).items()):
        value = precision(inner, (*name, k), seen)
        optional = k not in s.get("required", ())
        factors.append(value + optional if "oneOf" in inner else value * (1 + optional))
    return prod(factors)


def grouping(s, top=True):
    if "anyOf" in s:
        n = len(s["anyOf"]) + sum(grouping(b, False) for b in s["anyOf"])
    elif "oneOf" in s:
        n = sum(grouping(b, False) for b in s["oneOf"])
    elif "items" in s:
        n = grouping(s["items"], False)
    elif not s.get("properties"):
        return 0
    else:
        n = sum(grouping(b, False) for b in s["properties"].values())
    return max(n, 1) if top else n


def attributes(s, name=()):
    """Leaves with repeats."""
    if "anyOf" in s:
        return [a for b in s["anyOf"] for a in attributes(b, name)]
    if "items" in s:
        return attributes(s["items"], (*name, "[*]"))
    if not s.get("properties"):
        return [name]
    return [a for k, b in s["properties"].items() for a in attributes(b, (*name, k))]


def paths(s, path="$"):
    found = set()
    for b in s.get("anyOf", []) + s.get("oneOf", []):
        found |= paths(b, path)
    if "properties" in s:
        for k, b in s["properties"].items():
            found |= paths(b, f"{path}.{k}")
        return found | {path}
    if "items" in s:
        return found | paths(s["items"], path + "[*]") | {path + "[*]"}
    return found | {path}


def distance(test, truth, comparison):
    def one(t):
        t, g = paths(t), paths(truth)
        return {"symmetric": len(t ^ g), "diff": len(t - g), "sub": int(g <= t)}[comparison]

    return min(one(b) for b in test.get("anyOf", [test]))


# --- random inputs ----------------------------------------------------------------------

KEYS = "abcd"


def random_schema(rng, depth=3):
    roll = rng.random()
    if depth == 0 or roll < 0.3:
        return {"type": rng.choice(["string", "number", "boolean", "null", "array", "object"])}
    if roll < 0.45:
        word = rng.choice(["anyOf", "oneOf"])
        return {word: [random_schema(rng, depth - 1) for _ in range(rng.randint(1, 3))]}
    if roll < 0.6:
        s = {"type": "array", "items": random_schema(rng, depth - 1)}
        return s | ({"maxItems": rng.randint(0, 2)} if rng.random() < 0.3 else {})
    return random_object_schema(rng, depth)


def random_object_schema(rng, depth=3):
    keys = rng.sample(KEYS, rng.randint(0, 3))
    s = {"type": "object", "properties": {k: random_schema(rng, depth - 1) for k in keys}}
    if rng.random() < 0.5:
        s["required"] = rng.sample(KEYS, rng.randint(0, 2))
    if rng.random() < 0.3:
        s["additionalProperties"] = rng.random() < 0.8
    return s


def random_root(rng):
    if rng.random() < 0.5:
        return {"anyOf": [random_object_schema(rng) for _ in range(rng.randint(1, 3))]}
    return random_object_schema(rng)


def random_value(rng, s, depth=4):
    """Mostly what the schema asks for, now and then something else."""
    if depth == 0 or rng.random() < 0.12:
        return rng.choice(["x", 1, 2.5, True, None, {}, [], {"z": [1, {"w": []}]}, [None], {"a": 1}])
    if options(s) is not None:
        return random_value(rng, rng.choice(options(s)), depth)
    sort = s["type"]
    if sort == "object":
        known = s.get("properties", {})
        v = {k: random_value(rng, b, depth - 1) for k, b in known.items() if rng.random() < 0.8}
        return v | ({"e": {"f": [1]}} if rng.random() < 0.12 else {})
    if sort == "array":
        inner = s.get("items", {"type": "number"})
        return [random_value(rng, inner, depth - 1) for _ in range(rng.randint(0, 3))]
    return {"string": "s]}\\\"[", "number": 3, "boolean": False, "null": None}[sort]


# --- schemas with mistakes --------------------------------------------------------------


def code(s, v, failfast=True):
    """1 holds, 0 fails; 2 and 4 where an error decides: a node without a type, an empty oneOf."""
    if "anyOf" in s or "oneOf" in s:
        found = [c for c in (code(b, v, failfast) for b in options(s)) if c]
        return found[0] if found else 4 * (options(s) == [] and "anyOf" not in s and failfast)
    if "type" not in s:
        return 2 * failfast
    if SORTS[type(v)] != s["type"]:
        return 0
    if isinstance(v, list) and v:
        if len(v) > s.get("maxItems", len(v)):
            return 0
        found = [c for c in (code(s["items"], x, failfast) for x in v if "items" in s) if c != 1]
        return found[0] if found else 1
    if isinstance(v, dict):
        if not s.get("additionalProperties", False) and not all(k in v for k in s.get("required", ())):
            return 0
        if "properties" not in s:
            return int(not v)
        known, is_open = s["properties"], int(s.get("additionalProperties", False))
        found = [code(known[k], v[k], failfast) if k in known else is_open for k in sorted(v)]
        return next((c for c in found if c != 1), 1)
    return 1


def random_mistaken(rng, depth=3):
    roll = rng.random()
    if roll < 0.1:
        return rng.choice([{}, {"anyOf": []}, {"oneOf": []}, {"properties": {"a": {"type": "null"}}}, {"type": "object"}])
    s = random_schema(rng, depth)
    if "properties" in s:
        s["properties"] = {k: random_mistaken(rng, depth - 1) for k in rng.sample(KEYS, rng.randint(0, 3))}
    for word in ("anyOf", "oneOf"):
        if word in s:
            s[word] = [random_mistaken(rng, depth - 1) for _ in range(rng.randint(0, 3))]
    if "items" in s:
        s["items"] = random_mistaken(rng, depth - 1)
    return s


def random_instance(rng, s, depth=4):
    """As :func:`random_value`, for schemas with mistakes."""
    if "type" not in s and not options(s) or depth == 0:
        return rng.choice(["x", 1, None, {}, [], {"a": 1}, {"z": None}])
    if options(s):
        return random_instance(rng, rng.choice(options(s)), depth - 1)
    if s["type"] == "object":
        v = {k: random_instance(rng, b, depth - 1) for k, b in s.get("properties", {}).items() if rng.random() < 0.85}
        return v | ({"e": [{}]} if rng.random() < 0.1 else {})
    if s["type"] == "array":
        return [random_instance(rng, s.get("items", {}), depth - 1) for _ in range(rng.randint(0, 3))]
    return random_value(rng, s, depth)
