"""Comparison of small row lists in plain Python, the yardstick for the tests."""

import re
from collections import Counter

INTEGER = re.compile(r"[+-]?\d+(?:_\d+)*")


def list_text(value, integers=False, sep="|"):
    items = [stripped for part in (value or "").split(sep) if (stripped := part.strip())]
    digits = lambda item: sum(c.isdigit() for c in item)
    whole = [i for i in items if integers and INTEGER.fullmatch(i) and digits(i) <= 4300]
    return sep.join([str(n) for n in sorted(map(int, whole))] + sorted(i for i in items if i not in whole))


def op(value):
    code = (value or "").strip().upper()
    return "U" if code == "I" else code


def normalized(row, strictness, lists=("tags", "levels"), text_lists=("timestamps",), op_column="op_type"):
    out = {c: (v or "").strip() for c, v in row.items()}
    out[op_column] = op(row.get(op_column))
    for c in lists:
        out[c] = list_text(row.get(c), strictness == "B")
    for c in text_lists:
        out[c] = list_text(row.get(c))
    return out


def last_facts(rows, strictness, keys, **kw):
    """Of each key's last live row the (column, value) pairs that are not blank."""
    live = [normalized(row, strictness, **kw) for row in rows if op(row.get("op_type")) != "D"]
    return {"||".join(row[k] for k in keys): {f for f in row.items() if f[1]} for row in live}


def normalized_diff(before, after, strictness="A", keys=("user_id",), **kw):
    old, new = (last_facts(rows, strictness, keys, **kw) for rows in (before, after))
    one_sided = [(k, "INSERT", "") for k in new.keys() - old.keys()] + [(k, "DELETE", "") for k in old.keys() - new.keys()]
    apart = {k: {column for column, _ in old[k] ^ new[k]} for k in old.keys() & new.keys()}
    return sorted(one_sided + [(k, "UPDATE", "|".join(sorted(columns))) for k, columns in apart.items() if columns])


def _joined(row, keys):
    return "||".join(row[k] if row[k] is not None else "" for k in keys)


def raw_diff(before, after, keys):
    out = []

    def matches(x, y):
        return all(x[k] is not None and x[k] == y[k] for k in keys)

    for b in before:
        partners = [a for a in after if matches(b, a)]
        if not partners:
            out.append((_joined(b, keys), "DELETE", ""))
        out += [(_joined(b, keys), "UPDATE", "") for a in partners if a != b]
    for a in after:
        if not any(matches(b, a) for b in before):
            out.append((_joined(a, keys), "INSERT", ""))
    return Counter(out)


def fingerprint_diff(before, after, keys):
    def blanked(row):
        return {c: v if v is not None else "" for c, v in row.items()}

    last = {_joined(b, keys): blanked(b) for b in before}
    out, seen = [], set()
    for a in after:
        key = _joined(a, keys)
        seen.add(key)
        if key not in last:
            out.append((key, "INSERT", ""))
        elif last[key] != blanked(a):
            out.append((key, "UPDATE", ""))
    out += [(key, "DELETE", "") for key in last if key not in seen]
    return Counter(out)


def presence_diff(before, after, keys):
    def key(row):
        return None if any(row[k] is None for k in keys) else _joined(row, keys)

    b, a = [key(r) for r in before], [key(r) for r in after]
    out = [(k, "INSERT", "") for k in a if k is None or k not in b]
    out += [(k, "DELETE", "") for k in b if k is None or k not in a]
    out += [(k, "UPDATE", "") for k in b if k is not None for other in a if other == k]
    return Counter(out)
