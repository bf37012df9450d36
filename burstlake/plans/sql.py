"""The SQL that registered queries are compared with: common table expressions over the star schema, in DuckDB's dialect."""

from __future__ import annotations


def six(x: str) -> str:
    return f"floor(({x})*1e6+0.5)/1e6"


def _dealt(table: str, key: str, value: str, frames: int, side: int) -> str:
    area = side * side
    return f"""SELECT burst_id, frame_idx, y, x, v FROM (SELECT CAST({key} // {area * frames} AS BIGINT) AS burst_id, CAST(({key} // {area}) % {frames} AS INTEGER) AS frame_idx,
    CAST(({key} % {area}) // {side} AS INTEGER) AS y, CAST({key} % {side} AS INTEGER) AS x, floor(({value}) * 65535 + 0.5) AS v, count(*) OVER (PARTITION BY {key} // {area * frames}) AS n FROM {table}) WHERE n = {area * frames}"""


G2 = [2.718281828459045 ** (-0.5 * k * k) for k in range(-4, 5)]
G2 = [g / sum(G2) for g in G2]  # sigma 1, radius 4: down-sampling by 2
B1 = [2.718281828459045 ** (-0.5 * k * k) for k in range(-3, 4)]
B1 = [g / sum(B1) for g in B1]  # sigma 1, radius 3: blur
A, B = 1.80710882e-4, 3.1937599182e-6


def _taps(weights, axis, end=False):
    r, parts = len(weights) // 2, []
    for k, w in enumerate(weights):
        tap = f"lag(v,{r - k}) OVER w" if k < r else f"lead(v,{k - r}) OVER w" if k > r else "v"
        if end and k != r:
            tap = f"coalesce({tap}, {'first' if k < r else 'last'}_value(v) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))"
        parts.append(f"{w!r}::DOUBLE*({tap})")
    return "0.0::DOUBLE+" + "+".join(parts)


def _window(axis: str, keys: str = "burst_id, frame_idx") -> str:
    return f"WINDOW w AS (PARTITION BY {keys}, {'y' if axis == 'x' else 'x'} ORDER BY {axis})"


def _down(src: str, side: int) -> str:
    n = (side - 8) // 2
    return f"""SELECT burst_id, frame_idx, CAST((y-4)//2 AS INTEGER) AS y, x, v FROM (SELECT burst_id, frame_idx, y, x, {_taps(G2, 'y')} AS v FROM (
      SELECT burst_id, frame_idx, y, CAST((x-4)//2 AS INTEGER) AS x, v FROM (SELECT burst_id, frame_idx, y, x, {_taps(G2, 'x')} AS v FROM {src} {_window('x')}) WHERE x >= 4 AND (x-4)%2=0 AND (x-4)//2 < {n}) {_window('y')}) WHERE y >= 4 AND (y-4)%2=0 AND (y-4)//2 < {n}"""


OFFSETS = "(SELECT CAST(a.i AS INTEGER) AS i, CAST(b.j AS INTEGER) AS j FROM range(-{r}, {r}+1) a(i), range(-{r}, {r}+1) b(j))"


def _match(metric: str, r: int = 2) -> str:
    border = "coalesce(m.v, 0)" if metric == "L1" else "m.v"
    y, x = ("p.y+o.i", "p.x+o.j") if metric == "L1" else ("least(greatest(p.y+o.i,0),31)", "least(greatest(p.x+o.j,0),31)")
    cost = f"sum(abs(p.v-{border}))" if metric == "L1" else f"sum({border}*{border})-2*sum(p.v*{border})"
    return f"""SELECT burst_id, frame_idx, ty, tx, CAST(arg_min(j, k) AS DOUBLE) AS dx, CAST(arg_min(i, k) AS DOUBLE) AS dy, min(cost) AS cost FROM (
      SELECT *, cost*4096 + (i+{r})*64 + (j+{r}) AS k FROM (
      SELECT p.burst_id, f.frame_idx, p.y//8 AS ty, p.x//8 AS tx, o.i, o.j, {cost} AS cost
      FROM sc p, (SELECT CAST(unnest([1,2,3]) AS INTEGER) AS frame_idx) f, {OFFSETS.format(r=r)} o
      LEFT JOIN sc m ON m.burst_id=p.burst_id AND m.frame_idx=f.frame_idx AND m.y={y} AND m.x={x}
      WHERE p.frame_idx=0 GROUP BY ALL)) GROUP BY ALL"""


def _stats(src: str, keys: str) -> str:
    three = lambda c, ax: f"{c}+coalesce(lag({c}) OVER {ax}, {c})+coalesce(lead({c}) OVER {ax}, {c})"
    return f"""SELECT {keys}, y, x, s/9 AS mean, q/9-(s/9)*(s/9) AS var FROM (SELECT {keys}, y, x, {three('s', 'c')} AS s, {three('q', 'c')} AS q FROM (
      SELECT {keys}, y, x, {three('v', 'r')} AS s, {three('(v*v)', 'r')} AS q FROM {src} WINDOW r AS (PARTITION BY {keys}, y ORDER BY x)) WINDOW c AS (PARTITION BY {keys}, x ORDER BY y))"""


CFA = "[0,1,1,2][(y%2)*2+x%2+1]"
SPLINE = "CASE WHEN abs({0})<=0.5 THEN 1-2*abs({0})*abs({0}) WHEN abs({0})<=1.5 THEN abs({0})*abs({0})-2.5::DOUBLE*abs({0})+1.5::DOUBLE ELSE 0 END"
AWAY = "CASE WHEN {0}>=0 THEN floor({0}+0.5) ELSE ceil({0}-0.5) END"

STRENGTHS = """SELECT *, ((1-d)*({one})+d*3.5::DOUBLE)*0.30::DOUBLE AS k1, ((1-d)*({two})+d*3.5::DOUBLE)*0.30::DOUBLE AS k2 FROM (
      SELECT *, 1+sqrt(greatest((l1-l2)/(CASE WHEN l1+l2=0 THEN 1e-12 ELSE l1+l2 END),0)) AS an, least(greatest(1-sqrt(greatest(l1,0))/0.014::DOUBLE+0.005::DOUBLE,0),1) AS d FROM veigen)"""

CTES = {
    "ev": _dealt("events", "event_id", "least(value/600, 1e0)", 8, 8),
    "ord": _dealt("orders", "o_orderkey", "CAST(o_totalprice AS DOUBLE)/500000", 4, 32),
    "strip": """SELECT burst_id, frame_idx, CAST(r-d AS INTEGER) AS y, x, v FROM (SELECT CAST(o_orderkey//10752 AS BIGINT) AS burst_id, o_orderkey%10752//96 AS r, CAST(o_orderkey%96 AS INTEGER) AS x, floor(CAST(o_totalprice AS DOUBLE)/500000*65535+0.5) AS v, count(*) OVER (PARTITION BY o_orderkey//10752) AS n FROM orders),
      (VALUES (0,0),(1,5),(2,16)) t(frame_idx,d) WHERE n=10752 AND r-d BETWEEN 0 AND 95""",
    "sc": """SELECT burst_id, frame_idx, y, x, floor(least(greatest(0.5::DOUBLE + sin((Y2+X2)*0.20::DOUBLE)*0.4::DOUBLE*cos((X2-Y2)*0.13::DOUBLE) + CASE WHEN floor(abs(X2)*0.25::DOUBLE)%2=0 THEN 0.15::DOUBLE ELSE -0.15::DOUBLE END, 0), 1)*65535+0.5) AS v FROM (
      SELECT *, y + CASE WHEN frame_idx>0 THEN (burst_id+frame_idx)%3-1 ELSE 0 END AS Y2, x + CASE WHEN frame_idx>0 THEN (3*burst_id+2*frame_idx)%3-1 ELSE 0 END AS X2 FROM (
      SELECT CAST(s_suppkey AS BIGINT) AS burst_id, CAST(i//1024 AS INTEGER) AS frame_idx, CAST(i%1024//32 AS INTEGER) AS y, CAST(i%32 AS INTEGER) AS x FROM supplier, range(4096) t(i)))""",
    "evu": "SELECT burst_id, frame_idx, y, x, v/65535 AS v FROM ev",
    "scu": "SELECT burst_id, frame_idx, y, x, v/65535 AS v FROM sc",
    "grey": "SELECT burst_id, frame_idx, y//2 AS y, x//2 AS x, avg(v) AS v FROM evu GROUP BY ALL",
    "grad": "SELECT burst_id, frame_idx, y, x, (r-v+d-b)*0.25::DOUBLE AS gx, (b-v+d-r)*0.25::DOUBLE AS gy FROM (SELECT a.*, r.v AS r, b.v AS b, d.v AS d FROM evu a JOIN evu r ON r.burst_id=a.burst_id AND r.frame_idx=a.frame_idx AND r.y=a.y AND r.x=a.x+1 JOIN evu b ON b.burst_id=a.burst_id AND b.frame_idx=a.frame_idx AND b.y=a.y+1 AND b.x=a.x JOIN evu d ON d.burst_id=a.burst_id AND d.frame_idx=a.frame_idx AND d.y=a.y+1 AND d.x=a.x+1)",
    "tensor": "SELECT burst_id, frame_idx, y+i AS y, x+j AS x, sum(gx*gx) AS xx, sum(gx*gy) AS xy, sum(gy*gy) AS yy FROM grad, (SELECT a.i, b.j FROM range(0,2) a(i), range(0,2) b(j)) GROUP BY ALL",
    "vst": f"SELECT burst_id, frame_idx, y//2 AS y, x//2 AS x, avg({2 / A!r}::DOUBLE*sqrt(greatest(0, v*{A!r}::DOUBLE+{0.375 * A * A + B!r}::DOUBLE))) AS v FROM evu GROUP BY ALL",
    "vgrad": "SELECT burst_id, frame_idx, y, x, (r-v+d-b)*0.25::DOUBLE AS gx, (b-v+d-r)*0.25::DOUBLE AS gy FROM (SELECT a.*, r.v AS r, b.v AS b, d.v AS d FROM vst a JOIN vst r ON r.burst_id=a.burst_id AND r.frame_idx=a.frame_idx AND r.y=a.y AND r.x=a.x+1 JOIN vst b ON b.burst_id=a.burst_id AND b.frame_idx=a.frame_idx AND b.y=a.y+1 AND b.x=a.x JOIN vst d ON d.burst_id=a.burst_id AND d.frame_idx=a.frame_idx AND d.y=a.y+1 AND d.x=a.x+1)",
    "vtensor": "SELECT burst_id, frame_idx, y+i AS y, x+j AS x, sum(gx*gx) AS xx, sum(gx*gy) AS xy, sum(gy*gy) AS yy FROM vgrad, (SELECT a.i, b.j FROM range(0,2) a(i), range(0,2) b(j)) GROUP BY ALL",
    "veigen": """SELECT *, CASE WHEN iso THEN 1 WHEN a=0 THEN 0 WHEN b=0 THEN 1 ELSE a/n END AS e1x, CASE WHEN iso THEN 0 WHEN a=0 THEN 1 WHEN b=0 THEN 0 ELSE b/n END AS e1y,
      CASE WHEN iso THEN 0 WHEN a=0 THEN 1 WHEN b=0 THEN 0 WHEN a/n<0 THEN b/n ELSE -b/n END AS e2x, CASE WHEN iso THEN 1 WHEN a=0 THEN 0 WHEN b=0 THEN 1 ELSE abs(a/n) END AS e2y FROM (
      SELECT *, xx+xy-l2 AS a, xy+yy-l2 AS b, sqrt((xx+xy-l2)*(xx+xy-l2)+(xy+yy-l2)*(xy+yy-l2)) AS n, xy=0 AND xx=yy AS iso FROM (
      SELECT *, CASE WHEN abs(p)>=abs(q) THEN p ELSE q END AS l1, CASE WHEN abs(p)>=abs(q) THEN q ELSE p END AS l2 FROM (
      SELECT *, (xx+yy+s)/2 AS p, (xx+yy-s)/2 AS q FROM (SELECT *, sqrt(greatest((xx+yy)*(xx+yy)-4*(xx*yy-xy*xy),0)) AS s FROM vtensor))))""",
    "quads": f"SELECT burst_id, frame_idx, CAST({CFA} AS INTEGER) AS ch, y//2 AS y, x//2 AS x, avg(v) AS v FROM scu GROUP BY ALL",
    "qstats": _stats("quads", "burst_id, frame_idx, ch"),
    "flow1": _match("L1"),
    "central": "SELECT burst_id, frame_idx, y, x, v, coalesce(lead(v) OVER r,0)-coalesce(lag(v) OVER r,0) AS gx, coalesce(lead(v) OVER c,0)-coalesce(lag(v) OVER c,0) AS gy FROM scu WINDOW r AS (PARTITION BY burst_id, frame_idx, y ORDER BY x), c AS (PARTITION BY burst_id, frame_idx, x ORDER BY y)",
    "hess": "SELECT burst_id, y//8 AS ty, x//8 AS tx, sum(gx*gx) AS h00, sum(gx*gy) AS h01, sum(gy*gy) AS h11 FROM central WHERE frame_idx=0 GROUP BY ALL",
    "wref": f"""SELECT burst_id, ch, y, x, sum(k*mean)/sum(k) AS mean, sum(k*var)/sum(k) AS var FROM (
      SELECT p.burst_id, s.ch, p.y, p.x, s.mean, s.var, ({SPLINE.format('(s.y-gy)')})*({SPLINE.format('(s.x-gx)')}) AS k FROM (
      SELECT burst_id, y, x, (y+0.5::DOUBLE)/2-0.5::DOUBLE AS gy, (x+0.5::DOUBLE)/2-0.5::DOUBLE AS gx FROM scu WHERE frame_idx=0) p, {OFFSETS.format(r=1)} o, qstats s
      WHERE gy>=0 AND gx>=0 AND gy<16 AND gx<16 AND s.frame_idx=0 AND s.burst_id=p.burst_id AND s.y=least(greatest({AWAY.format('gy')}+o.i,0),15) AND s.x=least(greatest({AWAY.format('gx')}+o.j,0),15)) GROUP BY ALL""",
    "hrref": """SELECT burst_id, Y, X, CAST([0,1,1,2][(i%2)*2+j%2+1] AS INTEGER) AS ch, sum(k*v) AS num, sum(k) AS den FROM (
      SELECT g.burst_id, g.Y, g.X, i, j, s.v, exp(-0.5::DOUBLE*2*((j-cx)*(j-cx)+(i-cy)*(i-cy))) AS k FROM (
      SELECT b.burst_id, Y, X, cy, cx, CAST(round_even(cy,0) AS INTEGER)+o.i AS i, CAST(round_even(cx,0) AS INTEGER)+o.j AS j FROM (SELECT DISTINCT burst_id FROM sc) b,
      (SELECT a.i AS Y, c.i AS X, a.i/2e0 AS cy, c.i/2e0 AS cx FROM range(64) a(i), range(64) c(i)), """ + OFFSETS.format(r=1) + """ o) g
      JOIN (SELECT * FROM scu WHERE frame_idx=0) s ON s.burst_id=g.burst_id AND s.y=i AND s.x=j) GROUP BY ALL""",
    "hrcomp": """SELECT burst_id, Y, X, CAST([0,1,1,2][(i%2)*2+j%2+1] AS INTEGER) AS ch, sum(k*v) AS num, sum(k) AS den FROM (
      SELECT g.burst_id, g.Y, g.X, i, j, s.v, exp(-0.5::DOUBLE*2*((j-(mx-0.5::DOUBLE))*(j-(mx-0.5::DOUBLE))+(i-(my-0.5::DOUBLE))*(i-(my-0.5::DOUBLE)))) AS k FROM (
      SELECT *, CAST(floor(my) AS INTEGER)+oi AS i, CAST(floor(mx) AS INTEGER)+oj AS j FROM (
      SELECT f.burst_id, f.frame_idx, h.Y, h.X, h.ly+f.dy AS my, h.lx+f.dx AS mx, o.i AS oi, o.j AS oj FROM flow1 f
      JOIN (SELECT a.i AS Y, c.i AS X, (a.i+0.5::DOUBLE)/2 AS ly, (c.i+0.5::DOUBLE)/2 AS lx, a.i//16 AS ty, c.i//16 AS tx FROM range(64) a(i), range(64) c(i)) h ON f.ty=h.ty AND f.tx=h.tx, """ + OFFSETS.format(r=1) + """ o)
      WHERE mx>=0 AND mx<32 AND my>=0 AND my<32) g
      JOIN scu s ON s.burst_id=g.burst_id AND s.frame_idx=g.frame_idx AND s.y=i AND s.x=j) GROUP BY ALL""",
    "acc": "SELECT burst_id, Y, X, ch, sum(num) AS num, sum(den) AS den FROM (SELECT * FROM hrref UNION ALL SELECT * FROM hrcomp) GROUP BY ALL",
    "lin": "SELECT burst_id, Y, X, max(CASE WHEN ch=0 THEN v END) AS r, max(CASE WHEN ch=1 THEN v END) AS g, max(CASE WHEN ch=2 THEN v END) AS b FROM (SELECT *, " + six("num/den") + " AS v FROM hrref) GROUP BY ALL",
}


CTES |= {
    "cov": "SELECT burst_id, frame_idx, y, x, k1*k1*e1x*e1x+k2*k2*e2x*e2x AS xx, k1*k1*e1x*e1y+k2*k2*e2x*e2y AS xy, k1*k1*e1y*e1y+k2*k2*e2y*e2y AS yy FROM (" + STRENGTHS.format(one="1+an/2*(1/2e0-1)", two="1+an/2*(6e0-1)") + ")",
    "hardcov": "SELECT burst_id, frame_idx, y, x, k1*k1*e1x*e1x+k2*k2*e2x*e2x AS xx, k1*k1*e1x*e1y+k2*k2*e2x*e2y AS xy, k1*k1*e1y*e1y+k2*k2*e2y*e2y AS yy FROM (" + STRENGTHS.format(one="CASE WHEN an>1.95 THEN 0.5::DOUBLE ELSE 1 END", two="CASE WHEN an>1.95 THEN 6::DOUBLE ELSE 1 END") + ")",
    "cells": "SELECT burst_id, frame_idx//2 AS pair, frame_idx%2 AS side, y//3 AS cy, x//3 AS cx, sum(v) AS s, sum(v*v) AS q FROM ev GROUP BY ALL HAVING count(*)=9",
    "known": """SELECT CAST(least(greatest(floor(s*1000/1179630e0+0.5),0),1000) AS INTEGER) AS bin, avg(dev)/131070e0 AS sigma, avg(d)/589815e0 AS diff FROM (
      SELECT sum(s) AS s, max(s)-min(s) AS d, sum(sqrt(greatest(9*q-s*s,0))/9) AS dev FROM cells GROUP BY burst_id, pair, cy, cx HAVING count(*)=2) GROUP BY 1""",
    "lut": """SELECT bin, CASE WHEN lo IS NULL THEN cs WHEN hi IS NULL THEN sa ELSE sqrt(sa*sa*(1-p)+cs*cs*p) END AS sigma, CASE WHEN lo IS NULL THEN cd WHEN hi IS NULL THEN da ELSE sqrt(da*da*(1-p)+cd*cd*p) END AS diff FROM (
      SELECT g.bin, lo, hi, CASE WHEN lo<hi THEN (g.bin-lo)/(hi-lo) ELSE 0 END AS p, a.sigma AS sa, a.diff AS da, c.sigma AS cs, c.diff AS cd FROM (
      SELECT CAST(i AS INTEGER) AS bin, (SELECT max(bin) FROM known WHERE bin<=i) AS lo, (SELECT min(bin) FROM known WHERE bin>=i) AS hi FROM range(1001) t(i)) g LEFT JOIN known a ON a.bin=lo LEFT JOIN known c ON c.bin=hi)""",
    "wcomp": f"""SELECT burst_id, frame_idx, ch, y, x, sum(k*mean)/sum(k) AS moved FROM (
      SELECT p.burst_id, p.frame_idx, s.ch, p.y, p.x, s.mean, ({SPLINE.format('(s.y-gy)')})*({SPLINE.format('(s.x-gx)')}) AS k FROM (
      SELECT q.burst_id, q.frame_idx, q.y, q.x, (q.y+f.dy+0.5::DOUBLE)/2-0.5::DOUBLE AS gy, (q.x+f.dx+0.5::DOUBLE)/2-0.5::DOUBLE AS gx FROM scu q JOIN flow1 f ON f.burst_id=q.burst_id AND f.frame_idx=q.frame_idx AND f.ty=q.y//8 AND f.tx=q.x//8) p, {OFFSETS.format(r=1)} o, qstats s
      WHERE gy>=0 AND gx>=0 AND gy<16 AND gx<16 AND s.frame_idx=p.frame_idx AND s.burst_id=p.burst_id AND s.y=least(greatest({AWAY.format('gy')}+o.i,0),15) AND s.x=least(greatest({AWAY.format('gx')}+o.j,0),15)) GROUP BY ALL""",
    "rough": "SELECT f.burst_id, f.frame_idx, f.ty, f.tx, CASE WHEN pow(max(g.dx)-min(g.dx),2)+pow(max(g.dy)-min(g.dy),2) > 0.64 THEN 0.25::DOUBLE ELSE 24::DOUBLE END AS s FROM flow1 f JOIN flow1 g ON g.burst_id=f.burst_id AND g.frame_idx=f.frame_idx AND abs(g.ty-f.ty)<=1 AND abs(g.tx-f.tx)<=1 GROUP BY 1,2,3,4",
    "trust": f"""SELECT {{key}}, min(v) OVER (PARTITION BY burst_id, frame_idx, x ORDER BY y ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS v FROM (
      SELECT {{key}}, min(v) OVER (PARTITION BY burst_id, frame_idx, y ORDER BY x ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS v FROM (
      SELECT p.burst_id, p.frame_idx, p.y, p.x, CASE WHEN d2 IS NOT NULL AND s2>0 THEN least(greatest(r.s*exp(-d2/s2)-0.15::DOUBLE,0),1) END AS v FROM scu p
      JOIN rough r ON r.burst_id=p.burst_id AND r.frame_idx=p.frame_idx AND r.ty=p.y//8 AND r.tx=p.x//8 LEFT JOIN (
      SELECT m.burst_id, m.frame_idx, m.y, m.x, sum(CASE WHEN d>0 THEN d*d*(d*d/(d*d+l.diff*l.diff))*(d*d/(d*d+l.diff*l.diff)) ELSE 0 END) AS d2, sum(greatest(m.var, l.sigma*l.sigma)) AS s2 FROM (
      SELECT c.burst_id, c.frame_idx, c.y, c.x, w.mean, w.var, abs(w.mean-c.moved) AS d FROM wcomp c JOIN wref w ON w.burst_id=c.burst_id AND w.ch=c.ch AND w.y=c.y AND w.x=c.x) m
      JOIN lut l ON l.bin=least(greatest({AWAY.format('(mean*1000)')},0),1000) GROUP BY ALL) t ON t.burst_id=p.burst_id AND t.frame_idx=p.frame_idx AND t.y=p.y AND t.x=p.x WHERE p.frame_idx>0))""".replace("{key}", "burst_id, frame_idx, y, x"),
    "hrwide": """SELECT burst_id, Y, X, CAST([0,1,1,2][(i%2)*2+j%2+1] AS INTEGER) AS ch, bool_or(a<2) AS rep, sum(k*v) AS num, sum(k) AS den FROM (
      SELECT g.burst_id, g.Y, g.X, i, j, a, s.v, exp(-0.5::DOUBLE*(2*((j-cx)*(j-cx)+(i-cy)*(i-cy))/CASE WHEN a<=2 THEN 8e0 ELSE 1e0 END)) AS k FROM (
      SELECT b.burst_id, h.Y, h.X, cy, cx, t.v%4 AS a, o.i AS oi, o.j AS oj, CAST(round_even(cy,0) AS INTEGER)+o.i AS i, CAST(round_even(cx,0) AS INTEGER)+o.j AS j FROM (SELECT DISTINCT burst_id FROM sc) b,
      (SELECT a.i AS Y, c.i AS X, a.i/2e0 AS cy, c.i/2e0 AS cx FROM range(64) a(i), range(64) c(i)) h, """ + OFFSETS.format(r=2) + """ o, sc t
      WHERE t.burst_id=b.burst_id AND t.frame_idx=1 AND t.y=least(CAST(round_even(cy,0) AS INTEGER),31) AND t.x=least(CAST(round_even(cx,0) AS INTEGER),31)) g
      JOIN (SELECT * FROM scu WHERE frame_idx=0) s ON s.burst_id=g.burst_id AND s.y=i AND s.x=j WHERE greatest(abs(oi), abs(oj)) <= CASE WHEN a<=2 THEN 2 ELSE 1 END) GROUP BY ALL""",
    "cams": """SELECT CAST(s_suppkey AS BIGINT) AS burst_id, n_name, s_name, [s_nationkey/8+1, s_suppkey%4/2, n_regionkey/4+1] AS m, CASE WHEN s_suppkey%4>0 THEN [(s_nationkey/8+1)/(s_suppkey%4/2), 1e0, (n_regionkey/4+1)/(s_suppkey%4/2)] ELSE [1e0,1e0,1e0] END AS gain,
      CASE WHEN s_suppkey%2=0 THEN [0,1,1,2] ELSE [2,1,1,0] END AS cfa, s_suppkey, s_nationkey FROM supplier JOIN nation ON s_nationkey=n_nationkey""",
}


def _align(frames: str = "sc", sides=(32, 12), tiles=(8, 8), radii=(1, 2), metrics=("L1", "L2"), turns: int = 1) -> str:
    """From the coarsest level, one tile, to the finest: match, then refine. sides: of the square levels, halved each time; a
    tile of eight repeats the ends of a frame when it is refined, larger ones find nothing beyond it."""
    unit, deepest = f"{frames}u", len(sides) - 1
    parts = [f"{frames} AS ({CTES[frames]})", f"{unit} AS (SELECT burst_id, frame_idx, y, x, v/65535 AS v FROM {frames})"]
    for level in range(1, deepest + 1):
        parts.append(f"l{level} AS ({_down(unit if level == 1 else f'l{level - 1}', sides[level - 1])})")
    parts.append(f"l0 AS (SELECT * FROM {unit})")
    parts.append(f"s{deepest} AS (SELECT DISTINCT burst_id, frame_idx, 0 AS ty, 0 AS tx, 0e0 AS dx, 0e0 AS dy FROM l{deepest} WHERE frame_idx>0)")
    for level in range(deepest, -1, -1):
        side, tile, metric, r = sides[level], tiles[level], metrics[level], radii[level]
        n, up = max(1, side // tile), level + 1
        if level < deepest:
            whole = "" if side % tile == 0 else f" AND y//{tile}<{n} AND x//{tile}<{n}"
            repeat = max(1, 2 // max(1, tile // tiles[up]))
            parts.append(f"s{level} AS (SELECT g.burst_id, g.frame_idx, g.ty, g.tx, coalesce(f.dx*2,0) AS dx, coalesce(f.dy*2,0) AS dy FROM (SELECT DISTINCT burst_id, frame_idx, y//{tile} AS ty, x//{tile} AS tx FROM l{level} WHERE frame_idx>0{whole}) g LEFT JOIN f{up} f ON f.burst_id=g.burst_id AND f.frame_idx=g.frame_idx AND f.ty=g.ty//{repeat} AND f.tx=g.tx//{repeat})")
        held = lambda at: f"least(greatest({at},0),{side - 1})"
        free = lambda at: f"({at})"
        place = held if metric == "L2" else free
        cost, base = ("sum(m.v*m.v)-2*sum(p.v*m.v)", "{}") if metric == "L2" else ("sum(abs(p.v-coalesce(m.v,0)))", "round_even({},0)")
        parts += [
            f"""c{level} AS (SELECT p.burst_id, f.frame_idx, f.ty, f.tx, f.dx, f.dy, o.i, o.j, {cost} AS cost FROM l{level} p JOIN s{level} f ON f.burst_id=p.burst_id AND f.ty=p.y//{tile} AND f.tx=p.x//{tile}, {OFFSETS.format(r=r)} o
            LEFT JOIN l{level} m ON m.burst_id=p.burst_id AND m.frame_idx=f.frame_idx AND m.y={place('p.y+round_even(f.dy,0)+o.i')} AND m.x={place('p.x+round_even(f.dx,0)+o.j')} WHERE p.frame_idx=0 GROUP BY ALL)""",
            f"m{level} AS (SELECT burst_id, frame_idx, ty, tx, {base.format('dx')}+j AS dx, {base.format('dy')}+i AS dy FROM c{level} QUALIFY row_number() OVER (PARTITION BY burst_id, frame_idx, ty, tx ORDER BY cost, i, j)=1)",
            f"g{level} AS (SELECT burst_id, y, x, v, coalesce(lead(v) OVER r,0)-coalesce(lag(v) OVER r,0) AS gx, coalesce(lead(v) OVER c,0)-coalesce(lag(v) OVER c,0) AS gy FROM l{level} WHERE frame_idx=0 WINDOW r AS (PARTITION BY burst_id, y ORDER BY x), c AS (PARTITION BY burst_id, x ORDER BY y))",
            f"h{level} AS (SELECT burst_id, y//{tile} AS ty, x//{tile} AS tx, sum(gx*gx) AS h00, sum(gx*gy) AS h01, sum(gy*gy) AS h11 FROM g{level} GROUP BY ALL)",
        ]
        place, join, seen = (held, "JOIN", "m.v") if tile == 8 else (free, "LEFT JOIN", "coalesce(m.v,0)")
        for turn in range(turns):
            at, before = f"{level}" if turn == turns - 1 else f"{level}_{turn}", f"m{level}" if turn == 0 else f"f{level}_{turn - 1}"
            parts += [
                f"""w{at} AS (SELECT p.burst_id, f.frame_idx, f.ty, f.tx, p.y, p.x, p.v, p.gx, p.gy, trunc(f.dx) AS ax, trunc(f.dy) AS ay, f.dx-trunc(f.dx) AS fx, f.dy-trunc(f.dy) AS fy FROM g{level} p JOIN {before} f ON f.burst_id=p.burst_id AND f.ty=p.y//{tile} AND f.tx=p.x//{tile})""",
                f"""b{at} AS (SELECT burst_id, frame_idx, ty, tx, sum(-gx*(mov-v)) AS b0, sum(-gy*(mov-v)) AS b1 FROM (
            SELECT w.burst_id, w.frame_idx, w.ty, w.tx, w.y, w.x, w.v, w.gx, w.gy, sum((CASE WHEN o.j=1 THEN fx ELSE 1-fx END)*(CASE WHEN o.i=1 THEN fy ELSE 1-fy END)*{seen}) AS mov FROM w{at} w, (SELECT a.i, b.j FROM range(2) a(i), range(2) b(j)) o
            {join} l{level} m ON m.burst_id=w.burst_id AND m.frame_idx=w.frame_idx AND m.y={place('w.y+ay+o.i')} AND m.x={place('w.x+ax+o.j')} GROUP BY ALL) GROUP BY ALL)""",
                f"""f{at} AS (SELECT burst_id, frame_idx, ty, tx, CASE WHEN abs(det)>=1e-10 THEN dx+(h11*b0-h01*b1)/det ELSE dx END AS dx, CASE WHEN abs(det)>=1e-10 THEN dy+(h00*b1-h01*b0)/det ELSE dy END AS dy FROM (
            SELECT m.*, b0, b1, h00, h01, h11, h00*h11-h01*h01 AS det FROM {before} m JOIN b{at} b USING (burst_id, frame_idx, ty, tx) JOIN h{level} h ON h.burst_id=m.burst_id AND h.ty=m.ty AND h.tx=m.tx))""",
            ]
    return "WITH " + ",\n".join(parts) + f" SELECT burst_id, frame_idx, CAST(ty AS INTEGER) AS ty, CAST(tx AS INTEGER) AS tx, {six('dx')} AS dx, {six('dy')} AS dy FROM f0"


def sql(names: str, final: str) -> str:
    """WITH the named expressions in the order given."""
    listed = names.split()
    listed = ["ev"] + listed if "evu" in listed and "ev" not in listed else listed
    return ("WITH " + ",\n".join(f"{n} AS ({CTES[n]})" for n in listed) + "\n" if listed else "") + final


def srgb(v: str) -> str:
    c = f"least(greatest({v},0),1)"
    return f"CASE WHEN {c}<=0.0031308 THEN {c}*12.92 ELSE pow({c}, {1 / 2.4!r}::DOUBLE)*1.055-0.055 END"


KEY = "burst_id, frame_idx, y, x"
ORACLES = {
    "a3_manifest": "WITH f AS (SELECT event_id // 512 AS burst_id, (event_id // 64) % 8 AS part, max(ts) AS capture_ts FROM events GROUP BY ALL) SELECT burst_id, CAST(row_number() OVER (PARTITION BY burst_id ORDER BY capture_ts, part)-1 AS INTEGER) AS frame_idx, CAST(part AS BIGINT) AS part FROM f",
    "a4_reference_meta": sql("ev", "SELECT f.burst_id, f.frame_idx, m.* EXCLUDE burst_id FROM (SELECT DISTINCT burst_id, frame_idx FROM ev) f JOIN (SELECT burst_id, max(y)+1 AS h, max(x)+1 AS w, min(v) AS black, max(v) AS white FROM ev WHERE frame_idx=0 GROUP BY 1) m USING (burst_id)"),
    "a5_unpack": f"SELECT CAST(label AS BIGINT) AS burst_id, vec_id AS frame_idx, CAST(p//8 AS INTEGER) AS y, CAST(p%8 AS INTEGER) AS x, {six('CAST(embedding[p+1] AS DOUBLE)')} AS v FROM embeddings, range(64) t(p)",
    "a6_pack_tiles": sql("ev", "SELECT burst_id, frame_idx, CAST(y//4 AS INTEGER) AS ty, CAST(x//4 AS INTEGER) AS tx, min(y) AS y0, min(x) AS x0, string_agg(CAST(CAST(v AS BIGINT) AS VARCHAR), ',' ORDER BY y, x) AS data FROM ev GROUP BY ALL"),
    "a10_header": sql("cams", """SELECT CAST(s_suppkey AS BIGINT) AS burst_id, tag, name, value FROM (SELECT *, s_suppkey%8 AS flip, CASE WHEN s_suppkey%3>0 THEN s_name ELSE 'merged' END AS model FROM cams), LATERAL (
      SELECT * FROM (VALUES (254,'subfile','0'),(256,'width','64'),(257,'height','64'),(258,'bits','16 16 16'),(259,'compression','1'),(262,'photometric','34892'),(271,'make',n_name),(272,'model',model),(273,'strip_offset','0'),(277,'samples','3'),
      (274,'orientation',CASE WHEN s_suppkey%5>0 THEN CASE flip WHEN 3 THEN '3' WHEN 5 THEN '8' WHEN 6 THEN '6' ELSE '1' END END),(278,'rows_per_strip','64'),(279,'strip_bytes','24576'),(284,'planar','1'),(339,'sample_format','1 1 1'),(50706,'version','1 4 0 0'),(50707,'backward_version','1 3 0 0'),
      (50708,'unique_model',model),(50714,'black','0 0 0'),(50717,'white','65535 65535 65535'),(50719,'crop_origin','0 0'),(50720,'crop_size','64 64'),(50829,'active_area','0 0 64 64'),(50721,'matrix','1 0 0 0 1 0 0 0 1'),(50778,'illuminant','21')) t(tag,name,value)) WHERE value IS NOT NULL"""),
    "b_photometry": sql("evu", f"SELECT {KEY}, {six('least(greatest((v*65535-1000)/greatest(1, 65535-1000),0),1)')} AS norm, {six(f'{2 / A!r}::DOUBLE*sqrt(greatest(0, v*{A!r}::DOUBLE+{0.375 * A * A + B!r}::DOUBLE))')} AS stabilised, {six(srgb('v'))} AS srgb, CAST(floor(v*65535+0.5) AS INTEGER) AS v16, CAST(round_even(v*255,0) AS INTEGER) AS even8, CAST(floor(v*255+0.5) AS INTEGER) AS away8, {six(SPLINE.format('(v*2)'))} AS spline, CAST({CFA} AS INTEGER) AS ch, {six('t*t*(3-2*t)')} AS smooth, trunc((v-0.5::DOUBLE)*7) AS whole, {six('least(greatest((v-0.125::DOUBLE)/0.5::DOUBLE,0),1)*3+2')} AS line FROM (SELECT *, least(greatest((v-0.25::DOUBLE)/0.5::DOUBLE,0),1) AS t FROM evu)"),
    "b30_snr": sql("evu", f"SELECT burst_id, {six('mean')} AS mean, {six('snr')} AS snr, {six('(snr-6)/24*(0.29::DOUBLE-0.30::DOUBLE)+0.30::DOUBLE')} AS k_detail, {six('(snr-6)/24*(-2)+5')} AS k_denoise, CASE WHEN snr<=14 THEN 64 WHEN snr<=22 THEN 32 ELSE 16 END AS tile FROM (SELECT burst_id, mean, least(greatest(mean/sqrt(mean*{A!r}::DOUBLE+{B!r}::DOUBLE),6),30) AS snr FROM (SELECT burst_id, avg(v) AS mean FROM evu WHERE frame_idx=0 GROUP BY 1))"),
    "c2_centre_crop": sql("ev", "SELECT burst_id, frame_idx, CAST(y-2 AS INTEGER) AS y, CAST(x-2 AS INTEGER) AS x, v FROM ev WHERE y BETWEEN 2 AND 5 AND x BETWEEN 2 AND 5"),
    "c3_crop_to_reference": sql("ev", "SELECT * FROM ev WHERE y < 6 AND x < 6"),
    "c5_valid_bursts": sql("ev", "SELECT burst_id, count(*) AS samples FROM ev WHERE burst_id%3=0 GROUP BY 1"),
    "d1_box_grey": sql("evu grey", f"SELECT burst_id, frame_idx, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, {six('v')} AS v FROM grey"),
    "d2_low_pass": "WITH " + f"evu AS (SELECT burst_id, frame_idx, y, x, v/65535 AS v FROM ({CTES['ev']})), tw AS (SELECT d, sum(cos(2*pi()*k*d/8))/8 AS c, sum(sin(2*pi()*k*d/8))/8 AS s FROM range(0,8) a(d), (SELECT unnest([-2,-1,0,1]) AS k) GROUP BY d), rows_ AS (SELECT p.burst_id, p.frame_idx, p.y, CAST(o.i AS INTEGER) AS x, sum(p.v*t.c) AS re, sum(p.v*t.s) AS im FROM evu p, range(0,8) o(i), tw t WHERE t.d=(o.i-p.x+8)%8 GROUP BY ALL) SELECT burst_id, frame_idx, CAST(o.i AS INTEGER) AS y, x, {six('sum(re*t.c)-sum(im*t.s)')} AS v FROM rows_ r, range(0,8) o(i), tw t WHERE t.d=(o.i-r.y+8)%8 GROUP BY burst_id, frame_idx, o.i, x",
    "d4_pad_circular": sql("ev", "SELECT burst_id, frame_idx, CAST(a.i AS INTEGER) AS y, CAST(b.i AS INTEGER) AS x, v FROM ev, range(10) a(i), range(10) b(i) WHERE ev.y=a.i%8 AND ev.x=b.i%8"),
    "d5_downsample": "WITH sc AS (" + CTES["sc"] + "), scu AS (" + CTES["scu"] + "), d AS (" + _down("scu", 32) + f") SELECT burst_id, frame_idx, y, x, {six('v')} AS v FROM d",
    "d7_gradients": sql("evu grad", f"SELECT {KEY}, {six('gx')} AS gx, {six('gy')} AS gy FROM grad"),
    "d8_central": sql("sc scu central", f"SELECT {KEY}, {six('gx')} AS gx, {six('gy')} AS gy FROM central"),
    "d9_blur": sql("evu", f"SELECT {KEY}, {six('v')} AS v FROM (SELECT {KEY}, {_taps(B1, 'y', True)} AS v FROM (SELECT {KEY}, {_taps(B1, 'x', True)} AS v FROM evu {_window('x')}) {_window('y')})"),
    "d10_guide": sql("sc scu quads", f"SELECT burst_id, frame_idx, ch, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, {six('v')} AS v FROM quads"),
    "d11_local_stats": sql("evu", f"SELECT {KEY}, {six('mean')} AS mean, {six('var')} AS var FROM ({_stats('evu', 'burst_id, frame_idx')})"),
    "d12_local_min": sql("ev", f"SELECT {KEY}, min(v) OVER (PARTITION BY burst_id, frame_idx, x ORDER BY y ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS v FROM (SELECT {KEY}, min(v) OVER (PARTITION BY burst_id, frame_idx, y ORDER BY x ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS v FROM ev)"),
    "d13_structure_tensor": sql("evu grad tensor", f"SELECT burst_id, frame_idx, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, {six('xx')} AS xx, {six('xy')} AS xy, {six('yy')} AS yy FROM tensor"),
    "d14_kernel_field": sql("evu vst vgrad vtensor veigen", f"""SELECT burst_id, frame_idx, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, {six('k1*k1*e1x*e1x+k2*k2*e2x*e2x')} AS xx, {six('k1*k1*e1x*e1y+k2*k2*e2x*e2y')} AS xy, {six('k1*k1*e1y*e1y+k2*k2*e2y*e2y')} AS yy FROM (
      SELECT *, ((1-d)*(1+an/2*(1/2e0-1))+d*3.5)*0.30::DOUBLE AS k1, ((1-d)*(1+an/2*(6e0-1))+d*3.5)*0.30::DOUBLE AS k2 FROM (
      SELECT *, 1+sqrt(greatest((l1-l2)/(CASE WHEN l1+l2=0 THEN 1e-12 ELSE l1+l2 END),0)) AS an, least(greatest(1-sqrt(greatest(l1,0))/0.014::DOUBLE+0.005::DOUBLE,0),1) AS d FROM veigen))"""),
    "d15_flow_irregularity": sql("sc flow1", "SELECT f.burst_id, f.frame_idx, CAST(f.ty AS INTEGER) AS ty, CAST(f.tx AS INTEGER) AS tx, CASE WHEN pow(max(g.dx)-min(g.dx),2)+pow(max(g.dy)-min(g.dy),2) > 0.64 THEN 0.25::DOUBLE ELSE 24::DOUBLE END AS s FROM flow1 f JOIN flow1 g ON g.burst_id=f.burst_id AND g.frame_idx=f.frame_idx AND abs(g.ty-f.ty)<=1 AND abs(g.tx-f.tx)<=1 GROUP BY 1,2,3,4"),
    "e15_upscale_flow": sql("sc flow1", "SELECT f.burst_id, f.frame_idx, CAST(a.i AS INTEGER) AS ty, CAST(b.i AS INTEGER) AS tx, f.dx*2 AS dx, f.dy*2 AS dy FROM flow1 f, range(8) a(i), range(8) b(i) WHERE f.ty=a.i//2 AND f.tx=b.i//2"),
    "f4_hessian": sql("sc scu central hess", f"SELECT burst_id, CAST(ty AS INTEGER) AS ty, CAST(tx AS INTEGER) AS tx, {six('h00')} AS h00, {six('h01')} AS h01, {six('h11')} AS h11, {six('h00*h11-h01*h01')} AS det FROM hess"),
    "i1_block_match_l1": sql("sc", f"SELECT burst_id, frame_idx, CAST(ty AS INTEGER) AS ty, CAST(tx AS INTEGER) AS tx, dx, dy, cost FROM ({_match('L1')})"),
    "i1_block_match_l2": sql("sc", f"SELECT burst_id, frame_idx, CAST(ty AS INTEGER) AS ty, CAST(tx AS INTEGER) AS tx, dx, dy, cost FROM ({_match('L2')})"),
    "i2_refine_step": sql("sc scu central hess", f"""SELECT burst_id, frame_idx, CAST(ty AS INTEGER) AS ty, CAST(tx AS INTEGER) AS tx, {six('CASE WHEN abs(det)>=1e-10 THEN (h11*b0-h01*b1)/det ELSE 0 END')} AS dx, {six('CASE WHEN abs(det)>=1e-10 THEN (h00*b1-h01*b0)/det ELSE 0 END')} AS dy FROM (
      SELECT *, h00*h11-h01*h01 AS det FROM hess JOIN (SELECT r.burst_id, m.frame_idx, r.y//8 AS ty, r.x//8 AS tx, sum(-r.gx*(m.v-r.v)) AS b0, sum(-r.gy*(m.v-r.v)) AS b1 FROM central r JOIN scu m ON m.burst_id=r.burst_id AND m.y=r.y AND m.x=r.x AND m.frame_idx>0 WHERE r.frame_idx=0 GROUP BY ALL) USING (burst_id, ty, tx))"""),
    "i4_reference_stats": sql("sc scu quads qstats wref", f"SELECT p.burst_id, c.ch, p.y, p.x, {six('w.mean')} AS mean, {six('w.var')} AS var FROM scu p CROSS JOIN (SELECT CAST(unnest([0,1,2]) AS INTEGER) AS ch) c LEFT JOIN wref w ON w.burst_id=p.burst_id AND w.ch=c.ch AND w.y=p.y AND w.x=p.x WHERE p.frame_idx=0"),
    "i7_merge_reference": sql("sc scu hrref", f"SELECT burst_id, CAST(Y AS INTEGER) AS Y, CAST(X AS INTEGER) AS X, ch, {six('num')} AS num, {six('den')} AS den FROM hrref"),
    "i9_merge_all": sql("sc scu flow1 hrref hrcomp acc", f"SELECT burst_id, CAST(Y AS INTEGER) AS Y, CAST(X AS INTEGER) AS X, ch, {six('num/den')} AS v FROM acc"),
    "i12_encode": sql("sc scu hrref lin", "SELECT burst_id, CAST(Y AS INTEGER) AS Y, CAST(X AS INTEGER) AS X, CAST(floor(coalesce(r,0)*65535+0.5) AS INTEGER) AS r16, CAST(floor(coalesce(g,0)*65535+0.5) AS INTEGER) AS g16, CAST(floor(coalesce(b,0)*65535+0.5) AS INTEGER) AS b16 FROM lin"),
    "g5_preview": sql("sc scu hrref lin", f"SELECT burst_id, CAST(Y//4 AS INTEGER) AS py, CAST(X//4 AS INTEGER) AS px, CAST(floor(({srgb('r')})*255+0.5) AS INTEGER) AS r8, CAST(floor(({srgb('g')})*255+0.5) AS INTEGER) AS g8, CAST(floor(({srgb('b')})*255+0.5) AS INTEGER) AS b8 FROM lin WHERE Y%4=3 AND X%4=3"),
    "a1_burst_scan": sql("ev", """, p AS (SELECT burst_id*8+frame_idx AS path, y, x, v FROM ev WHERE (burst_id*8+frame_idx)%2=1 OR y<7), good AS (SELECT path FROM p GROUP BY 1 HAVING sum(v)%3<>0),
      f AS (SELECT event_id//512 AS burst_id, event_id//64 AS path, max(ts) AS t FROM events GROUP BY ALL), k AS (SELECT f.burst_id, f.path, row_number() OVER (PARTITION BY f.burst_id ORDER BY t, f.path)-1 AS n FROM f JOIN good USING (path)),
      r AS (SELECT burst_id, (max(y)+1)//2*2 AS h FROM k JOIN p USING (path) WHERE n=0 GROUP BY 1) SELECT k.burst_id, CAST(k.n AS INTEGER) AS frame_idx, p.y, p.x, p.v FROM k JOIN p USING (path) JOIN r ON r.burst_id=k.burst_id WHERE p.y<r.h"""),
    "a2_frame_scan": sql("ev", f"SELECT {KEY}, v FROM ev WHERE burst_id=0 AND frame_idx=3"),
    "a4_settings": sql("cams", f"SELECT burst_id, n_name AS make, s_name AS model, {six('gain[1]')} AS gain_r, {six('gain[2]')} AS gain_g, {six('gain[3]')} AS gain_b, array_to_string(cfa, '') AS cfa, CASE s_suppkey%8 WHEN 3 THEN 3 WHEN 5 THEN 8 WHEN 6 THEN 6 ELSE 1 END AS orientation, CASE WHEN s_suppkey%3=0 THEN 2 ELSE 1 END AS crop FROM cams"),
    "a8_retention": "SELECT event_id//512 AS burst_id, count(*) AS n FROM events GROUP BY 1 HAVING max(ts) >= (SELECT max(ts) FROM events) - INTERVAL 48 HOURS",
    "a9_output_rows": sql("sc scu hrref lin", """SELECT burst_id, count(DISTINCT Y) AS rows, CAST(max(Y)+1 AS INTEGER) AS expected, count(DISTINCT Y)=max(Y)+1 AS complete, count(*) AS pixels, CAST(sum(k*(r16+3*g16+7*b16)) AS BIGINT) AS ordered FROM (
      SELECT burst_id, Y, row_number() OVER (PARTITION BY burst_id ORDER BY Y, X) AS k, """ + ", ".join(f"CAST(floor(least(greatest(coalesce({n},0),0),1)*65535+0.5) AS BIGINT) AS {n}16" for n in "rgb") + " FROM lin) GROUP BY 1"),
    "a11_export": sql("sc scu hrref lin", "SELECT burst_id, CAST(Y AS INTEGER) AS Y, CAST(X AS INTEGER) AS X, CAST(floor(coalesce(r,0)*65535+0.5) AS INTEGER) AS r16, CAST(floor(coalesce(g,0)*65535+0.5) AS INTEGER) AS g16, CAST(floor(coalesce(b,0)*65535+0.5) AS INTEGER) AS b16 FROM lin"),
    "b7_colour": sql("sc scu quads cams", "SELECT burst_id, CAST(y AS INTEGER) AS Y, CAST(x AS INTEGER) AS X, " + ", ".join(six("+".join(f"({1 if i == k else 0}+(s_nationkey+{3 * i + k})%5/16)*v{k}" for k in range(3))) + f" AS {n}" for i, n in enumerate("rgb")) + " FROM (SELECT q.burst_id, q.y, q.x, s_nationkey, " + ", ".join(f"max(CASE WHEN ch={k} THEN v END)*any_value(gain[{k + 1}]) AS v{k}" for k in range(3)) + " FROM quads q JOIN cams c ON c.burst_id=q.burst_id WHERE frame_idx=0 GROUP BY 1,2,3,4)"),
    "b22_config": sql("sc scu", f"""SELECT CAST(s_suppkey AS BIGINT) AS burst_id, {six('CASE WHEN s_suppkey%2=0 THEN s_suppkey/16 ELSE 0.15::DOUBLE END')} AS r_t, {six('CASE WHEN snr_on THEN 0.30::DOUBLE-0.01::DOUBLE*p ELSE s_suppkey%4/8 END')} AS k_detail,
      {six('CASE WHEN snr_on THEN 5-2*p ELSE 3.5::DOUBLE END')} AS k_denoise, {six('CASE WHEN snr_on THEN 0.81::DOUBLE-0.1::DOUBLE*p ELSE 0.005::DOUBLE END')} AS D_th, {six('CASE WHEN snr_on THEN 1.24::DOUBLE-0.24::DOUBLE*p ELSE 0.014::DOUBLE END')} AS D_tr, {six(f'{A!r}::DOUBLE')} AS alpha,
      {six(f'4.5::DOUBLE*({A!r}::DOUBLE+sqrt(9*{A!r}::DOUBLE*{A!r}::DOUBLE+4*{B!r}::DOUBLE))')} AS noise_low, {six(f'(2+9*{A!r}::DOUBLE-sqrt((2+9*{A!r}::DOUBLE)*(2+9*{A!r}::DOUBLE)-4*(1+9*{B!r}::DOUBLE)))/2')} AS noise_high, 24::DOUBLE AS r_s2, s_suppkey%5+0.5::DOUBLE AS k_stretch, snr_on AS snr_tuning,
      s_suppkey%2<>0 AS denoise_accumulated, CASE WHEN s_suppkey%7>0 THEN (s_suppkey%7)::DOUBLE ELSE 2 END AS denoise_frames, 8::DOUBLE AS denoise_power, CAST(CASE WHEN NOT snr_on THEN 16 WHEN snr<=14 THEN 64 WHEN snr<=22 THEN 32 ELSE 16 END AS INTEGER) AS tile,
      CAST(CASE WHEN NOT snr_on THEN 8 WHEN snr<=14 THEN 32 WHEN snr<=22 THEN 16 ELSE 8 END AS INTEGER) AS coarse_tile FROM (SELECT *, (snr-6)/24 AS p FROM (SELECT s_suppkey, s_suppkey%3<>0 AS snr_on, least(greatest(mean/sqrt(mean*{A!r}::DOUBLE+{B!r}::DOUBLE),6),30) AS snr FROM supplier JOIN (SELECT burst_id, avg(v) AS mean FROM scu WHERE frame_idx=0 GROUP BY 1) ON burst_id=s_suppkey))"""),
    "c4_not_empty": sql("ev", "SELECT burst_id, frame_idx, h, CAST(1 AS INTEGER) AS w FROM (SELECT burst_id, frame_idx, CAST(count(*) FILTER (v%2=0)%3 AS INTEGER) AS h FROM ev GROUP BY ALL) WHERE h>0"),
    "c11_first_frames": sql("ev", "SELECT burst_id, count(*) AS samples, max(frame_idx) AS last FROM ev WHERE frame_idx<2 GROUP BY 1"),
    "d3_fourier": sql("evu", f"SELECT burst_id, frame_idx, CAST((a.i+4)%8 AS INTEGER) AS y, CAST((b.i+4)%8 AS INTEGER) AS x, {six('sum(v*cos(2*pi()*(a.i*y+b.i*x)/8))')} AS v, {six('-sum(v*sin(2*pi()*(a.i*y+b.i*x)/8))')} AS im FROM evu, range(8) a(i), range(8) b(i) GROUP BY burst_id, frame_idx, a.i, b.i"),
    "d3_inverse": sql("evu", f"SELECT {KEY}, {six('v')} AS v FROM evu"),
    "d14_hard": sql("evu vst vgrad vtensor veigen hardcov", f"SELECT burst_id, frame_idx, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, {six('xx')} AS xx, {six('xy')} AS xy, {six('yy')} AS yy FROM hardcov"),
    "e5_bilinear": sql("sc scu", f"SELECT p.burst_id, p.frame_idx, p.y, p.x, {six('sum((CASE WHEN o.j=1 THEN 0.375::DOUBLE ELSE 0.625::DOUBLE END)*(CASE WHEN o.i=1 THEN -0.25::DOUBLE ELSE 1.25::DOUBLE END)*coalesce(m.v,0))')} AS mov FROM scu p, (SELECT a.i, b.j FROM range(2) a(i), range(2) b(j)) o LEFT JOIN scu m ON m.burst_id=p.burst_id AND m.frame_idx=p.frame_idx AND m.y=p.y+o.i AND m.x=p.x+o.j WHERE p.frame_idx=1 GROUP BY 1,2,3,4"),
    "e6_bilinear_clamped": sql("sc scu", f"SELECT p.burst_id, p.frame_idx, p.y, p.x, {six('sum((CASE WHEN o.j=1 THEN -0.625::DOUBLE ELSE 1.625::DOUBLE END)*(CASE WHEN o.i=1 THEN 0.25::DOUBLE ELSE 0.75::DOUBLE END)*m.v)')} AS mov FROM scu p, (SELECT a.i, b.j FROM range(2) a(i), range(2) b(j)) o JOIN scu m ON m.burst_id=p.burst_id AND m.frame_idx=p.frame_idx AND m.y=least(greatest(p.y+2+o.i,0),31) AND m.x=least(greatest(p.x-1+o.j,0),31) WHERE p.frame_idx=1 GROUP BY 1,2,3,4"),
    "e8_kernel_at": sql("evu vst vgrad vtensor veigen cov", f"""SELECT burst_id, frame_idx, y, x, {six('(CASE WHEN abs(xx*yy-xy*xy)>1e-10 THEN yy/(xx*yy-xy*xy) ELSE 1 END)/1000')} AS ixx, {six('(CASE WHEN abs(xx*yy-xy*xy)>1e-10 THEN -xy/(xx*yy-xy*xy) ELSE 0 END)/1000')} AS ixy, {six('(CASE WHEN abs(xx*yy-xy*xy)>1e-10 THEN xx/(xx*yy-xy*xy) ELSE 1 END)/1000')} AS iyy FROM (
      SELECT p.burst_id, p.frame_idx, p.y, p.x, """ + ", ".join(f"sum((CASE WHEN o.j=1 THEN fx ELSE 1-fx END)*(CASE WHEN o.i=1 THEN fy ELSE 1-fy END)*c.{n}) AS {n}" for n in ("xx", "xy", "yy")) + """ FROM (
      SELECT *, y/2-0.5::DOUBLE-floor(y/2-0.5::DOUBLE) AS fy, x/2-0.5::DOUBLE-floor(x/2-0.5::DOUBLE) AS fx, least(greatest(trunc(y/2-0.5::DOUBLE),0),3) AS y0, least(greatest(trunc(x/2-0.5::DOUBLE),0),3) AS x0 FROM evu) p, (SELECT a.i, b.j FROM range(2) a(i), range(2) b(j)) o
      JOIN cov c ON c.burst_id=p.burst_id AND c.frame_idx=p.frame_idx AND c.y=least(p.y0+o.i,3) AND c.x=least(p.x0+o.j,3) GROUP BY 1,2,3,4)"""),
    "e16_settings": sql("sc scu cams", f"SELECT p.burst_id, p.y, p.x, cfa[(p.y%2)*2+p.x%2+1] AS ch, {six('p.v*gain[cfa[(p.y%2)*2+p.x%2+1]+1]')} AS v FROM scu p JOIN cams c ON c.burst_id=p.burst_id WHERE p.frame_idx=0"),
    "e17_complete": sql("ev", "SELECT DISTINCT burst_id, frame_idx FROM ev e WHERE burst_id%4>0 AND ((frame_idx>0 AND (frame_idx+burst_id)%3>0) OR (frame_idx=0 AND EXISTS (SELECT 1 FROM ev c WHERE c.burst_id=e.burst_id AND c.frame_idx>0 AND (c.frame_idx+c.burst_id)%3>0)))"),
    "f3_correlation": sql("sc", f"SELECT p.burst_id, m.frame_idx, CAST(p.y//8 AS INTEGER) AS ty, CAST(p.x//8 AS INTEGER) AS tx, o.i AS oy, o.j AS ox, sum(p.v*m.v) AS corr FROM sc p, {OFFSETS.format(r=1)} o JOIN sc m ON m.burst_id=p.burst_id AND m.frame_idx>0 AND m.y=least(greatest(p.y+o.i,0),31) AND m.x=least(greatest(p.x+o.j,0),31) WHERE p.frame_idx=0 GROUP BY ALL"),
    "f7_accumulated": sql("ev sc scu quads qstats wref flow1 wcomp rough cells known lut trust", f"SELECT burst_id, y, x, CASE WHEN count(v)=3 THEN {six('sum(v)')} END AS v FROM trust GROUP BY 1,2,3"),
    "f9_noise_curves": sql("ev cells known lut", f"SELECT bin, {six('sigma')} AS sigma, {six('diff')} AS diff FROM lut WHERE sigma IS NOT NULL"),
    "h2_replaced": sql("sc scu flow1 hrcomp hrwide", f"""SELECT burst_id, CAST(Y AS INTEGER) AS Y, CAST(X AS INTEGER) AS X, ch, {six('CASE WHEN rep THEN rn ELSE rn+cn END')} AS num, {six('CASE WHEN rep THEN rd ELSE rd+cd END')} AS den FROM (
      SELECT burst_id, Y, X, ch, bool_or(rep) OVER (PARTITION BY burst_id, Y, X) AS rep, coalesce(r.num,0) AS rn, coalesce(r.den,0) AS rd, coalesce(c.num,0) AS cn, coalesce(c.den,0) AS cd FROM hrwide r FULL JOIN hrcomp c USING (burst_id, Y, X, ch))"""),
    "h3_pyramid": "WITH sc AS (" + CTES["sc"] + "), scu AS (" + CTES["scu"] + "), d AS (" + _down("scu", 32) + f") SELECT {KEY}, {six('v')} AS v, CAST(level AS INTEGER) AS level FROM (SELECT *, 0 AS level FROM scu UNION ALL SELECT *, unnest([1,2]) AS level FROM d)",
    "i1_tiles": sql("sc", f"SELECT burst_id, frame_idx, CAST(ty AS INTEGER) AS ty, CAST(tx AS INTEGER) AS tx, dx, dy, cost FROM ({_match('L1')})"),
    "i3_align": _align(),
    "i3_tiles": _align(),
    "i3_four_levels": _align("strip", (96, 44, 18, 5), (16, 16, 16, 8), (1, 4, 4, 4), ("L1", "L2", "L2", "L2"), 3),
    "i5_robustness": sql("ev sc scu quads qstats wref flow1 wcomp rough cells known lut trust", f"SELECT {KEY}, {six('v')} AS v FROM trust"),
    "j1_burst_assembly": "SELECT event_id // 512 AS burst_id, 'complete' AS status, 8 AS n FROM events GROUP BY 1 HAVING count(*)=512",
}


def _steered(trusted: bool = False, frames: str = "sc") -> str:
    """All frames with the steerable kernel: the covariance between four grey pixels, inverted, weighs the nine samples around;
    trusted: comparison frames by their robustness as well."""
    grid = "(SELECT a.i AS Y, c.i AS X, a.i/2e0 AS cy, c.i/2e0 AS cx, (a.i+0.5::DOUBLE)/2 AS ly, (c.i+0.5::DOUBLE)/2 AS lx, a.i//16 AS ty, c.i//16 AS tx FROM range(64) a(i), range(64) c(i))"
    weight = lambda n: f"sum((CASE WHEN o.j=1 THEN fx ELSE 1-fx END)*(CASE WHEN o.i=1 THEN fy ELSE 1-fy END)*c.{n}) AS {n}"
    inverse = ", ".join(f"CASE WHEN abs(xx*yy-xy*xy)>1e-10 THEN {a}/(xx*yy-xy*xy) ELSE {b} END AS {n}" for n, a, b in (("ixx", "yy", 1), ("ixy", "-xy", 0), ("iyy", "xx", 1)))
    robust = ("ev", "quads", "qstats", "wref", "wcomp", "rough", "cells", "known", "lut", "trust") if trusted else ()
    named = {n: CTES[n] for n in ("sc", "scu", "vst", "vgrad", "vtensor", "veigen", "cov", "flow1", *robust)}
    named["sc"] = CTES[frames]
    named["vst"] = named["vst"].replace("evu", "scu")
    named["pts"] = f"""SELECT b.burst_id, 0 AS frame_idx, Y, X, cy AS py, cx AS px, round_even(cy,0) AS sy, round_even(cx,0) AS sx, cy/2-0.5::DOUBLE AS ky, cx/2-0.5::DOUBLE AS kx, 0 AS ry, 0 AS rx FROM (SELECT DISTINCT burst_id FROM sc) b, {grid}
      UNION ALL SELECT burst_id, frame_idx, Y, X, my-0.5::DOUBLE, mx-0.5::DOUBLE, floor(my), floor(mx), my/2-0.5::DOUBLE, mx/2-0.5::DOUBLE, floor(ly), floor(lx) FROM (
      SELECT f.burst_id, f.frame_idx, h.Y, h.X, ly, lx, ly+f.dy AS my, lx+f.dx AS mx FROM flow1 f JOIN {grid} h ON f.ty=h.ty AND f.tx=h.tx) WHERE mx>=0 AND mx<32 AND my>=0 AND my<32"""
    named["inv"] = f"""SELECT burst_id, frame_idx, Y, X, py, px, sy, sx, ry, rx, {inverse} FROM (
      SELECT p.burst_id, p.frame_idx, p.Y, p.X, any_value(py) AS py, any_value(px) AS px, any_value(sy) AS sy, any_value(sx) AS sx, any_value(ry) AS ry, any_value(rx) AS rx, {weight('xx')}, {weight('xy')}, {weight('yy')} FROM (
      SELECT *, ky-floor(ky) AS fy, kx-floor(kx) AS fx, least(greatest(trunc(ky),0),15) AS y0, least(greatest(trunc(kx),0),15) AS x0 FROM pts) p, (SELECT a.i, b.j FROM range(2) a(i), range(2) b(j)) o
      JOIN cov c ON c.burst_id=p.burst_id AND c.frame_idx=p.frame_idx AND c.y=least(p.y0+o.i,15) AND c.x=least(p.x0+o.j,15) GROUP BY 1,2,3,4)"""
    named["taps"] = f"""SELECT g.burst_id, g.Y, g.X, CAST([0,1,1,2][(i%2)*2+j%2+1] AS INTEGER) AS ch, s.v, CASE WHEN k=0 AND oi=0 AND oj=0 THEN 1 ELSE k END{'*CASE WHEN g.frame_idx>0 THEN t.v ELSE 1 END' if trusted else ''} AS k FROM (
      SELECT *, exp(-0.5::DOUBLE*greatest(ixx*(j-px)*(j-px)+2*ixy*(j-px)*(i-py)+iyy*(i-py)*(i-py),0)) AS k FROM (SELECT n.*, o.i AS oi, o.j AS oj, CAST(sy AS INTEGER)+o.i AS i, CAST(sx AS INTEGER)+o.j AS j FROM inv n, {OFFSETS.format(r=1)} o)) g
      JOIN scu s ON s.burst_id=g.burst_id AND s.frame_idx=g.frame_idx AND s.y=i AND s.x=j{' LEFT JOIN trust t ON t.burst_id=g.burst_id AND t.frame_idx=g.frame_idx AND t.y=ry AND t.x=rx' if trusted else ''}"""
    final = f"SELECT burst_id, CAST(Y AS INTEGER) AS Y, CAST(X AS INTEGER) AS X, ch, {six('CASE WHEN den>0 THEN num/den ELSE 0 END')} AS v FROM (SELECT burst_id, Y, X, ch, sum(k*v) AS num, sum(k) AS den FROM taps GROUP BY ALL)"
    return "WITH " + ",\n".join(f"{n} AS ({q})" for n, q in named.items()) + "\n" + final


ORACLES |= {
    "b26_steered": _steered(),
    "i9_process": _steered(trusted=True),
    "i9_orders": _steered(trusted=True, frames="ord"),
    "j5_late": "SELECT burst_id, u.status, u.n FROM (SELECT event_id//512 AS burst_id FROM events GROUP BY 1 HAVING count(*)=512), (VALUES ('complete', 6), ('late', 2)) u(status, n)",
    "e16_two_cameras": sql("sc scu cams", f"""SELECT burst_id, CAST(Y AS INTEGER) AS Y, CAST(X AS INTEGER) AS X, CAST(ch AS INTEGER) AS ch, {six('num/den*gain[ch+1]')} AS v FROM (SELECT g.burst_id, Y, X, c.gain, c.cfa[(i%2)*2+j%2+1] AS ch, sum(k*v) AS num, sum(k) AS den FROM (
      SELECT t.*, s.v, exp(-0.5::DOUBLE*2*((j-cx)*(j-cx)+(i-cy)*(i-cy))) AS k FROM (
      SELECT b.burst_id, Y, X, cy, cx, CAST(round_even(cy,0) AS INTEGER)+o.i AS i, CAST(round_even(cx,0) AS INTEGER)+o.j AS j FROM (SELECT DISTINCT burst_id FROM sc) b,
      (SELECT a.i AS Y, c.i AS X, a.i/2e0 AS cy, c.i/2e0 AS cx FROM range(64) a(i), range(64) c(i)), {OFFSETS.format(r=1)} o) t
      JOIN (SELECT * FROM scu WHERE frame_idx=0) s ON s.burst_id=t.burst_id AND s.y=i AND s.x=j) g JOIN cams c ON c.burst_id=g.burst_id GROUP BY ALL)"""),
    "a7_stage_store": sql("ev", "SELECT burst_id, frame_idx, y, x, v+CASE burst_id%3 WHEN 1 THEN 1 WHEN 0 THEN 2 ELSE 0 END AS v FROM ev"),
}
# Tile forms give the rows of the forms sample by sample.
ORACLES |= {tiled: ORACLES[plain] for tiled, plain in (
    ("d5_tiles", "d5_downsample"), ("d9_tiles", "d9_blur"), ("d11_tiles", "d11_local_stats"), ("d12_tiles", "d12_local_min"), ("d14_tiles", "d14_kernel_field"), ("i5_tiles", "i5_robustness"),
    ("f7_tiles", "f7_accumulated"), ("i7_tiles", "i7_merge_reference"), ("i9_tiles", "i9_merge_all"), ("h2_tiles", "h2_replaced"), ("b26_tiles", "b26_steered"),
)}
