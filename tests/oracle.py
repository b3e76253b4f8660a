"""A plain proof search over tuples, to hold the distributed one against."""

from __future__ import annotations


def _canon(atoms):
    names: dict = {}
    return tuple((p, *(names.setdefault(x, f"?{len(names)}") if x.startswith("?") else x for x in (a, b))) for p, a, b in atoms)


def _walk(x, s):
    while x in s:
        x = s[x]
    return x


def _children(atoms, facts, rules, query, fresh):
    (p, a, b), rest = atoms[0], atoms[1:]
    for q, h, t in facts:
        if q == p and (q, h, t) != query:
            s: dict = {}
            for x, y in ((a, h), (b, t)):
                x = _walk(x, s)
                if x.startswith("?"):
                    s[x] = y
                elif x != y:
                    break
            else:
                yield tuple((r, _walk(x, s), _walk(y, s)) for r, x, y in rest)
    for (hp, ha, hb), body in rules:
        if hp != p:
            continue
        ren = lambda x: f"?r{fresh}{x}" if x[0].isupper() else x
        s = {}
        for x, y in ((ren(ha), a), (ren(hb), b)):
            x, y = _walk(x, s), _walk(y, s)
            if x == y:
                continue
            if x.startswith("?"):
                s[x] = y
            elif y.startswith("?"):
                s[y] = x
            else:
                break
        else:
            yield tuple((r, _walk(ren(x), s), _walk(ren(y), s)) for r, x, y in body) + tuple((r, _walk(x, s), _walk(y, s)) for r, x, y in rest)


def min_depth(query, facts, rules, max_depth=8, max_atoms=20):
    known = set(facts) - {query}
    frontier, seen = {(query,)}, {(query,)}
    for depth in range(1, max_depth + 1):
        new = set()
        for state in frontier:
            for child in _children(state, facts, rules, query, depth):
                left = _canon(tuple(x for x in child if x not in known))
                if not left:
                    return depth
                if len(left) <= max_atoms and left not in seen:
                    new.add(left)
        seen |= new
        frontier = new
        if not frontier:
            break
    return -1
