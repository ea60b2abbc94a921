"""DuckDB SQL for clustering: the same algorithms as recursive queries, written from their definitions.

Each text is a list of common table expressions over ``p`` (event_id, idx, px, py, pz, energy, pt, phi,
rapidity), of which ``jets`` (event_id, members) is the last: a row for every jet with the indices of its particles.
"""

from __future__ import annotations

GAP = "least(abs(a.phi - b.phi) % (2 * pi()), 2 * pi() - abs(a.phi - b.phi) % (2 * pi()))"
DISTANCE2 = f"({GAP} * {GAP} + (a.rapidity - b.rapidity) * (a.rapidity - b.rapidity))"
RAPIDITY = "case when pz = 0 then 0e0 else sign(pz) * 0.5 * ln((pt * pt + greatest(energy * energy - pz * pz - pt * pt, 0)) / ((energy - abs(pz)) * (energy - abs(pz)))) end"


#: Distances and momenta that agree within this part of them are a tie, and the first wins.
TIE = "1e-9"


def recombination(delta_r: float, factor: str = "1e0", own: str = "1e0") -> str:
    """Sequential recombination. ``n`` has the live nodes of every step, and the nodes that became jets in it; child1 and
    child2 of the node that was made. ``factor`` is of nodes a and b, ``own`` of a node."""
    return f"""n as (
        select event_id, 0 as step, idx as label, count(*) over (partition by event_id) as top, count(*) over (partition by event_id) as live, px, py, pz, energy, pt, phi, rapidity,
            [idx] as members, -1::bigint as child1, -1::bigint as child2, false as jet from p
        union all
        select event_id, step, label, top, live, px, py, pz, energy, pt, phi, {RAPIDITY}, members, child1, child2, jet from (
            select event_id, step, label, top, live, px, py, pz, energy, sqrt(px * px + py * py) pt, atan2(py, px) phi, members, child1, child2, jet from (
                with c as (select event_id, min({{'i': i, 'j': j}}) b from (select *, min(d) over (partition by event_id) least from (
                    select a.event_id, a.label i, b.label j, {DISTANCE2} * {factor} * {factor} d from n a join n b on a.event_id = b.event_id and a.label < b.label where a.live > 1 and not a.jet and not b.jet
                    union all select event_id, label, label, {delta_r}e0 * {delta_r}e0 * {own} * {own} from n where live > 1 and not jet)) where d <= least * (1 + {TIE}) group by event_id)
                select n.event_id, step + 1 as step, label, top + (c.b.i <> c.b.j)::int as top, live - 1 as live, px, py, pz, energy, members, -1::bigint as child1, -1::bigint as child2, label = c.b.i as jet
                    from n join c on n.event_id = c.event_id where not n.jet and (c.b.i = c.b.j or label <> c.b.i and label <> c.b.j)
                union all
                select n.event_id, min(step) + 1, min(top), min(top) + 1, min(live) - 1, sum(px), sum(py), sum(pz), sum(energy), flatten(list(members order by label)), min(label), max(label), false
                    from n join c on n.event_id = c.event_id where c.b.i <> c.b.j and not n.jet and (label = c.b.i or label = c.b.j) group by n.event_id))),
    jets as (select event_id, members from n where jet or live = 1)"""


def cone(delta_r: float, threshold: float = 1.0, stable: float = 0.01, turns: int = 100) -> str:
    """Iterative cones. The hardest particles within TIE of one another are equal, and the first of them seeds. ``c`` has a row for every turn of a cone; ``made`` is the jet that ends with it."""
    each = lambda column: f"list_sum(list_transform(inside, lambda x: t.{column}[x + 1]))"
    gap = "least(abs(f.phi - t.phi[x + 1]) % (2 * pi()), 2 * pi() - abs(f.phi - t.phi[x + 1]) % (2 * pi()))"
    near = f"list_filter(f.free, lambda x: {gap} * {gap} + (f.y - t.y[x + 1]) * (f.y - t.y[x + 1]) < {delta_r}e0 * {delta_r}e0)"
    return f"""t as (select event_id, list(rapidity order by idx) y, list(phi order by idx) phi, list(pt order by idx) pt, list(energy order by idx) e, list(px order by idx) px, list(py order by idx) py, list(pz order by idx) pz from p group by event_id),
    c as (
        select event_id, list(idx order by idx) as free, null::double as y, null::double as phi, null::double as e, []::bigint[] as members, []::bigint[][] as seen, 0 as turn, null::bigint[] as made from p group by event_id
        union all
        select * from (select event_id, case when stop then list_filter(free, lambda x: not list_contains(last, x)) else free end, case when not stop then ny end, case when not stop then nphi end, case when not stop then ne end,
            last, case when stop then []::bigint[][] else list_append(seen, inside) end, case when stop then 0 else turn + 1 end, case when stop then last end
        from (select *, case when again then members else inside end as last, again or abs(ne - e) / abs(ne) <= {stable}e0 or turn + 1 >= {turns} as stop, {RAPIDITY.replace('energy', 'ne')} ny from (
            select *, sqrt(px * px + py * py) pt, atan2(py, px) nphi, len(inside) = 0 or list_contains(seen, inside) as again from (
                select f.event_id, f.free, f.e, f.members, f.seen, f.turn, inside, {each('e')} ne, {each('px')} px, {each('py')} py, {each('pz')} pz from (select f.*, {near} inside from c f join t on f.event_id = t.event_id where f.y is not null) f join t on f.event_id = t.event_id)))
        union all
        select f.event_id, f.free, t.y[s + 1], t.phi[s + 1], t.e[s + 1], [s], []::bigint[][], 0, null from (
            select c.*, list_min(list_filter(c.free, lambda x: t.pt[x + 1] >= (1 - {TIE}) * list_max(list_transform(c.free, lambda z: t.pt[z + 1])))) s from c join t on c.event_id = t.event_id where c.y is null and len(c.free) > 0) f join t on f.event_id = t.event_id where t.pt[s + 1] > {threshold}e0)),
    jets as (select event_id, made as members from c where made is not null union all
        select p.event_id, [p.idx] from p where not exists (select 1 from c where c.event_id = p.event_id and list_contains(c.made, p.idx)))"""


#: Sum of the heat kernel's series that is enough for eigenvalues up to 2, and places of its Chebyshev mean.
TERMS, PLACES = 28, 51


def wavelets(sigma: float = 0.1, cutoff: float = 0.0, rounds: int = 15) -> str:
    """Heat wavelets. ``k`` is exp(-L) of each event's normalised Laplacian, by its series; half of the mean of exp(-x)
    over the Chebyshev places of [0, 2] is taken off its diagonal, which is what the approximation's constant term lacks.
    ``w`` has them scaled to [-1, 1] by seed, ``c`` the groups seed by seed."""
    return f"""a2 as (select a.event_id, a.idx i, b.idx j, exp(-{DISTANCE2} / {sigma}e0) v, sqrt({DISTANCE2}) * least(1 / a.pt, 1 / b.pt) s from p a join p b on a.event_id = b.event_id and a.idx <> b.idx),
    deg as (select event_id, i, sum(v) d, sum(s) s from a2 group by all),
    one as (select event_id, idx from p where (event_id, idx) not in (select event_id, i from deg)),
    l as (select a2.event_id, a2.i, a2.j, -a2.v / sqrt(x.d * y.d) v from a2 join deg x on a2.event_id = x.event_id and a2.i = x.i join deg y on a2.event_id = y.event_id and a2.j = y.i where x.d > 0 and y.d > 0 union all select event_id, i, i, 1e0 from deg where d > 0),
    e as (select event_id, i, i as j, 1e0 v, 0 as m from deg union all
        select e.event_id, e.i, l.j, -sum(e.v * l.v) / (min(e.m) + 1), min(e.m) + 1 from e join l on e.event_id = l.event_id and e.j = l.i where e.m < {TERMS} group by e.event_id, e.i, l.j),
    h as (select 0.5e0 * avg(exp(-1e0 - cos(pi() * (u + 0.5e0) / {PLACES}))) half from (select unnest(range({PLACES})) u)),
    k as (select event_id, i, j, sum(v) - case when i = j then (select half from h) else 0e0 end v from e group by event_id, i, j),
    w as (select event_id, i as seed, j as idx, 2 * (v - min(v) over g) / (max(v) over g - min(v) over g) - 1 as v from k window g as (partition by event_id, i)),
    b as (select event_id, seed, list(idx order by idx) below from w where v < {cutoff}e0 group by all),
    o as (select event_id, list(i order by s, i) seeds from deg group by event_id),
    c as (
        select event_id, 0 as place, 0 as used, (select list(idx) from p where p.event_id = o.event_id) as free, []::bigint[] as made from o
        union all
        select event_id, place + 1, used + taken::int, case when taken then list_filter(free, lambda x: not list_contains(below, x)) else free end, case when taken then list_filter(free, lambda x: list_contains(below, x)) else []::bigint[] end from (
            select c.*, coalesce(b.below, []::bigint[]) below, list_contains(c.free, o.seeds[c.place + 1]) and c.used < least({rounds}, len(o.seeds)) as taken
            from c join o on c.event_id = o.event_id left join b on b.event_id = c.event_id and b.seed = o.seeds[c.place + 1] where c.place < len(o.seeds))),
    jets as (select event_id, made as members from c where len(made) > 0 union all select event_id, [unnest(arg_max(free, place))] from c group by event_id union all select event_id, [idx] from one)"""


#: The partition and the jets' momenta, as :func:`queries._partition` returns them.
PARTITION = """select j.event_id, p.idx, jet, n, round(sqrt(x * x + y * y), 4) + 0e0 as pt, round(e, 4) + 0e0 as energy from (
    select m.event_id, m.members, list_min(m.members) jet, len(m.members) n, sum(px) x, sum(py) y, sum(energy) e from jets m join p on m.event_id = p.event_id and list_contains(m.members, p.idx) group by all) j
    join p on j.event_id = p.event_id and list_contains(j.members, p.idx)"""
