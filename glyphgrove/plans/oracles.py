"""SQL that states the result of each catalogue query by its definition, for DuckDB.

The statements are assembled from common table expressions. They follow the pairwise definitions
(every distance, every candidate cost), not the formulas the operators use.
"""

from __future__ import annotations

from glyphgrove.functions.paths import ROOT
from glyphgrove.operators.consensus import TRIALS
from glyphgrove.operators.postings import BLOCK_FRAMES
from glyphgrove.plans.inputs import FRAME, GAP, K, MIN_POINTS, TREE_K
from glyphgrove.plans.queries import EXCLUDE_RECENT, MIN_SCORE, POOL

BITS = "CASE WHEN e > 0 THEN 1 ELSE 0 END"
BYTES = "CAST(floor((CAST(e AS DOUBLE) + 1) * 127.5) AS INTEGER)"

HAMMING = "sum(CASE WHEN a.x <> b.x THEN 1 ELSE 0 END)"
L1 = "sum(abs(CAST(a.x AS DOUBLE) - CAST(b.x AS DOUBLE)))"
CHEBYSHEV = "max(abs(CAST(a.x AS DOUBLE) - CAST(b.x AS DOUBLE)))"
L2SQ = "sum((CAST(a.x AS DOUBLE) - b.x) * (CAST(a.x AS DOUBLE) - b.x))"


def select(ctes: list[str], final: str) -> str:
    return f"WITH RECURSIVE {', '.join(ctes)} {final}"


def cte(name: str, body: str) -> str:
    return f"{name} AS MATERIALIZED ({body})"


def elements(value: str, name: str = "el") -> str:
    """(id, j, x) of every descriptor."""
    return cte(
        name,
        f"SELECT id, j, {value} AS x FROM (SELECT vec_id AS id, unnest(range(len(embedding))) AS j, "
        "unnest(embedding) AS e FROM embeddings)",
    )


def distances(metric: str, name: str = "dm", source: str = "el") -> str:
    return cte(
        name,
        f"SELECT a.id AS a, b.id AS b, {metric} AS d FROM {source} a JOIN {source} b USING (j) GROUP BY 1, 2",
    )


POINTS = cte("pts", f"SELECT '{ROOT}' AS node_id, vec_id AS id FROM embeddings")


def seeds(points: str, k: int, prefix: str, dm: str = "dm") -> list[str]:
    """Farthest-first medoids ``{prefix}med(node_id, pos, id)`` of every node."""
    parts = [cte(f"{prefix}s0", f"SELECT node_id, min(id) AS id FROM {points} GROUP BY node_id")]
    for r in range(1, k):
        near = "d.d" if r == 1 else "least(n.near, d.d)"
        source = points if r == 1 else f"{prefix}n{r - 1}"
        parts.append(cte(
            f"{prefix}n{r}",
            f"SELECT n.node_id, n.id, {near} AS near FROM {source} n JOIN {prefix}s{r - 1} s "
            f"USING (node_id) JOIN {dm} d ON d.a = n.id AND d.b = s.id",
        ))
        parts.append(cte(
            f"{prefix}s{r}",
            "SELECT node_id, id FROM (SELECT node_id, id, row_number() OVER (PARTITION BY node_id "
            f"ORDER BY near DESC, id) AS rn FROM {prefix}n{r}) WHERE rn = 1",
        ))
    union = " UNION ALL ".join(
        f"SELECT node_id, {r} AS pos, id FROM {prefix}s{r}" for r in range(k)
    )
    return [*parts, cte(f"{prefix}med", union)]


def assignment(points: str, medoids: str, name: str, dm: str = "dm") -> str:
    return cte(
        name,
        "SELECT node_id, id, pos, d AS dist FROM (SELECT p.node_id, p.id, m.pos, d.d, row_number() "
        f"OVER (PARTITION BY p.node_id, p.id ORDER BY d.d, m.pos) AS rn FROM {points} p JOIN "
        f"{medoids} m USING (node_id) JOIN {dm} d ON d.a = p.id AND d.b = m.id "
        f"WHERE p.id NOT IN (SELECT id FROM {medoids})) WHERE rn = 1",
    )


def costs(assigned: str, name: str, dm: str = "dm") -> str:
    return cte(
        name,
        f"SELECT a.node_id, a.pos, a.id, sum(d.d) AS cost FROM {assigned} a JOIN {assigned} b "
        f"USING (node_id, pos) JOIN {dm} d ON d.a = a.id AND d.b = b.id GROUP BY 1, 2, 3",
    )


def updated(medoids: str, cost: str, name: str) -> str:
    return cte(
        name,
        f"SELECT m.node_id, m.pos, coalesce(b.id, m.id) AS id FROM {medoids} m LEFT JOIN "
        "(SELECT node_id, pos, id FROM (SELECT *, row_number() OVER (PARTITION BY node_id, pos "
        f"ORDER BY cost, id) AS rn FROM {cost}) WHERE rn = 1) b USING (node_id, pos)",
    )


def seeded(value: str = BITS, metric: str = HAMMING) -> list[str]:
    return [elements(value), distances(metric), POINTS, *seeds("pts", K, "")]


def assigned(value: str = BITS, metric: str = HAMMING) -> list[str]:
    return [*seeded(value, metric), assignment("pts", "med", "asg")]


#: Iterations and tree levels the statements are unrolled to; more than the test data need.
ROUNDS = 8
LEVELS = 5


def converged(points: str, medoids: str, prefix: str, dm: str = "dm", cost: str = "dm", best: bool = False) -> list[str]:
    """``{prefix}m(node_id, pos, id)``: each node iterated until its cost first fails to drop.

    The node ends with the medoids of that partition, with ``best`` with those of the one before.
    """
    parts, now = [], medoids
    for i in range(ROUNDS):
        p = f"{prefix}r{i}_"
        total = (
            f"SELECT n.node_id, coalesce(sum(c.cost), 0) AS total FROM (SELECT DISTINCT node_id FROM {now}) n "
            f"LEFT JOIN {p}c c USING (node_id) GROUP BY 1"
        )
        parts += [
            assignment(points, now, f"{p}asg", dm), costs(f"{p}asg", f"{p}c", cost), cte(f"{p}t", total),
            updated(now, f"{p}c", f"{prefix}r{i + 1}_med"),
        ]
        if i == 0:
            parts.append(cte(f"{prefix}r0_med", f"SELECT * FROM {medoids}"))
        now = f"{prefix}r{i + 1}_med"
    stops = " UNION ALL ".join(
        f"SELECT b.node_id, {i} AS i FROM {prefix}r{i}_t b JOIN {prefix}r{i - 1}_t a USING (node_id) WHERE b.total >= a.total"
        for i in range(1, ROUNDS)
    )
    parts.append(cte(f"{prefix}stop", f"SELECT node_id, min(i) AS i FROM ({stops}) GROUP BY 1"))
    back = 1 if best else 0
    parts.append(cte(f"{prefix}m", " UNION ALL ".join(
        f"SELECT m.node_id, m.pos, m.id FROM {prefix}r{i - back}_med m JOIN {prefix}stop s ON s.node_id = m.node_id "
        f"AND s.i = {i}" for i in range(1, ROUNDS)
    )))
    return parts


def fitted(point: str, cost: str, value: str, best: bool = False, opening: list[str] | None = None) -> list[str]:
    """``fin``: K medoids fitted until the cost stops dropping."""
    return [
        elements(value), distances(point), distances(cost, "cm"), POINTS, *(opening or seeds("pts", K, "")),
        *converged("pts", "med", "f_", "dm", "cm", best), cte("fin", "SELECT * FROM f_m"),
    ]


RANDOM = [cte(
    "med",
    f"SELECT '{ROOT}' AS node_id, row_number() OVER (ORDER BY md5(vec_id || ':11'), vec_id) - 1 AS pos, vec_id AS id "
    f"FROM embeddings ORDER BY md5(vec_id || ':11'), vec_id LIMIT {K}",
)]

#: The distinct descriptors, each under its lowest id.
DISTINCT_POINTS = cte(
    "pts",
    f"SELECT '{ROOT}' AS node_id, min(id) AS id FROM (SELECT id, string_agg(CAST(x AS VARCHAR), '' ORDER BY j) AS v "
    "FROM el GROUP BY id) GROUP BY v",
)


def tree() -> list[str]:
    """The tree with TREE_K children per node, split while a cluster has more members: nodes, members, words."""
    k = TREE_K
    parts = [elements(BITS), distances(HAMMING), DISTINCT_POINTS]
    child = f"CASE WHEN node_id = '{ROOT}' THEN CAST(pos AS VARCHAR) ELSE node_id || '-' || pos END"
    for level in range(1, LEVELS + 1):
        points, p = ("pts" if level == 1 else f"pts{level}"), f"l{level}_"
        parts += [
            *seeds(points, k, p), *converged(points, f"{p}med", p), assignment(points, f"{p}m", f"{p}asg"),
            cte(f"{p}placed", f"SELECT {child} AS node_id, id FROM {p}asg"),
            cte(
                f"{p}nodes",
                f"SELECT m.node_id, m.parent_id, m.pos, {level} AS depth, m.id, coalesce(s.size, 0) AS size, CASE WHEN "
                f"coalesce(s.size, 0) <= {k} THEN 1 ELSE 0 END AS is_leaf FROM (SELECT {child} AS node_id, node_id AS "
                f"parent_id, pos, id FROM {p}m) m LEFT JOIN (SELECT node_id, count(*) AS size FROM {p}placed GROUP BY "
                "1) s USING (node_id)",
            ),
            cte(
                f"pts{level + 1}",
                f"SELECT p.node_id, p.id FROM {p}placed p JOIN {p}nodes n USING (node_id) WHERE n.is_leaf = 0",
            ),
        ]
    every = lambda name: " UNION ALL ".join(f"SELECT * FROM l{i}_{name}" for i in range(1, LEVELS + 1))
    parts += [
        cte("nodes", every("nodes")),
        cte("members",
            "SELECT p.node_id, row_number() OVER (PARTITION BY p.node_id ORDER BY p.id) - 1 AS pos, p.id FROM ("
            f"{every('placed')}) p JOIN nodes n ON n.node_id = p.node_id WHERE n.is_leaf = 1"),
        cte("lists",
            "SELECT node_id || '-' || pos AS word_id, node_id AS leaf_id FROM members UNION ALL "
            "SELECT node_id, node_id FROM nodes WHERE is_leaf = 1 AND node_id NOT IN "
            "(SELECT node_id FROM members)"),
        cte("words",
            "SELECT word_id, leaf_id, row_number() OVER (ORDER BY CAST(string_split(word_id, '-') AS "
            "INTEGER[])) - 1 AS word_index FROM lists"),
        cte("levels",
            "SELECT parent_id AS node_id, pos, id FROM nodes UNION ALL "
            "SELECT node_id, pos, id FROM members"),
    ]
    return parts


def tree_quantised() -> list[str]:
    """``q(frame_id, pos, id, word_id)`` by descent through ``levels``."""
    parts = tree()
    parts.append(cte("w0", f"SELECT vec_id AS id, '{ROOT}' AS word_id FROM embeddings"))
    for i in range(LEVELS + 1):
        parts.append(cte(
            f"w{i + 1}",
            f"SELECT w.id, CASE WHEN b.pos IS NULL THEN w.word_id WHEN w.word_id = '{ROOT}' THEN "
            f"CAST(b.pos AS VARCHAR) ELSE w.word_id || '-' || b.pos END AS word_id FROM w{i} w LEFT "
            "JOIN (SELECT id, pos FROM (SELECT w.id, l.pos, row_number() OVER (PARTITION BY w.id "
            f"ORDER BY d.d, l.pos) AS rn FROM w{i} w JOIN levels l ON l.node_id = w.word_id JOIN dm d "
            "ON d.a = w.id AND d.b = l.id) WHERE rn = 1) b USING (id)",
        ))
    parts.append(cte(
        "q", f"SELECT id // {FRAME} AS frame_id, CAST(id % {FRAME} AS INTEGER) AS pos, id, word_id FROM w{LEVELS + 1}"
    ))
    return parts


BAG = [
    cte("wts", "SELECT word_id, count(*) / CAST((SELECT count(*) FROM q) AS DOUBLE) AS weight FROM q GROUP BY 1"),
    cte("raw", "SELECT q.frame_id, w.word_index, sum(t.weight) AS raw FROM q JOIN words w USING (word_id) "
               "JOIN wts t USING (word_id) GROUP BY 1, 2"),
    cte("bow", "SELECT frame_id, word_index, raw / sum(raw) OVER (PARTITION BY frame_id) AS weight FROM raw"),
]

FRAMES = cte(
    "fr",
    f"SELECT frame_id, n_points, row_number() OVER (ORDER BY frame_id) AS seq, lag(frame_id) OVER "
    f"(ORDER BY frame_id) AS prev_frame_id, frame_id * 1000000 AS time_us FROM (SELECT vec_id // {FRAME} AS "
    "frame_id, count(*) AS n_points FROM embeddings GROUP BY 1)",
)

#: Similarity of all frame pairs by the definition 1 - 0.5 * sum |a - b| over all words.
SIMILARITY = cte(
    "sim",
    "SELECT a.frame_id AS qf, b.frame_id AS f, 1 - 0.5 * (SELECT sum(abs(coalesce(x.weight, 0) - "
    "coalesce(y.weight, 0))) FROM words w LEFT JOIN bow x ON x.word_index = w.word_index AND "
    "x.frame_id = a.frame_id LEFT JOIN bow y ON y.word_index = w.word_index AND y.frame_id = "
    "b.frame_id) AS score FROM fr a, fr b",
)


def picks(source: str, key: str, time_us: str, gap: int, start: int | None, name: str) -> str:
    """Recursive walk ``{name}(key, time_us)``: first row, then the next row more than ``gap`` further."""
    first = f" WHERE {time_us} > {start} + {gap}" if start is not None else ""
    return (
        f"{name} AS (SELECT {key}, min({time_us}) AS {time_us} FROM {source}{first} GROUP BY {key} UNION ALL "
        f"SELECT p.{key}, (SELECT min(s.{time_us}) FROM {source} s WHERE s.{key} = p.{key} AND s.{time_us} > "
        f"p.{time_us} + {gap}) FROM {name} p WHERE EXISTS (SELECT 1 FROM {source} s WHERE s.{key} = p.{key} "
        f"AND s.{time_us} > p.{time_us} + {gap}))"
    )


def scored() -> list[str]:
    """``sc(query_id, frame_id, time_us, score)`` over key frames of the tree vocabulary."""
    return [
        *tree_quantised(), *BAG, FRAMES, SIMILARITY,
        cte("el_fr", f"SELECT 0 AS stream_id, seq FROM fr WHERE n_points > {MIN_POINTS}"),
        picks("el_fr", "stream_id", "seq", GAP + 1, 0, "kp"),
        cte("kf", "SELECT frame_id, prev_frame_id, time_us FROM fr JOIN kp USING (seq)"),
        cte("sc",
            "SELECT k.frame_id AS query_id, o.frame_id, o.time_us, s.score / e.score AS score FROM kf k JOIN "
            "sim e ON e.qf = k.frame_id AND e.f = k.prev_frame_id JOIN kf o ON o.time_us < k.time_us JOIN sim s ON "
            "s.qf = k.frame_id AND s.f = o.frame_id WHERE e.score >= 0.1 AND s.score / e.score > 0.3"),
    ]


def island_rows() -> list[str]:
    return [
        *scored(),
        picks("sc", "query_id", "time_us", POOL, None, "ip"),
        cte("isl", "SELECT s.*, (SELECT max(p.time_us) FROM ip p WHERE p.query_id = s.query_id AND p.time_us <= "
                   "s.time_us) AS island_id FROM sc s"),
        cte("tot", "SELECT query_id, island_id, round(sum(score), 12) AS island_score, count(*) AS "
                   "island_frames FROM isl GROUP BY 1, 2"),
        cte("rk", "SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY island_score DESC, "
                  "island_id) AS rn FROM tot"),
    ]


ANCESTOR = (
    "CASE WHEN instr({w}, '-') = 0 THEN '" + ROOT + "' ELSE regexp_replace({w}, '-[0-9]+$', '') END"
)


def ancestor(word: str) -> str:
    return ANCESTOR.format(w=word)


def below(word: str, node: str) -> str:
    return f"({node} = '{ROOT}' OR starts_with({word}, {node} || '-'))"


EVENTS = (
    "SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS "
    "seq FROM events"
)

KEYS = (
    "SELECT string_agg(CAST(x AS VARCHAR), '.' ORDER BY j) AS key, count(*) AS n FROM el GROUP BY id"
)

KEYFRAMES = select(
    [
        cte("ev", EVENTS),
        cte("ok", "SELECT user_id, seq FROM ev WHERE value > 50"),
        picks("ok", "user_id", "seq", 21, 0, "kp"),
    ],
    "SELECT e.user_id AS stream_id, e.seq, e.event_id, e.value AS n_points FROM ev e JOIN kp USING "
    "(user_id, seq)",
)

KALMAN = select(
    [
        cte("ev", EVENTS),
        # a: predicted covariance, h: its product with the measurement row
        "st AS (SELECT user_id, CAST(0 AS BIGINT) AS seq, CAST(-1 AS BIGINT) AS event_id, "
        "CAST(0 AS DOUBLE) AS predicted, CAST(0 AS DOUBLE) AS angle, CAST(0 AS DOUBLE) AS rate, "
        "CAST(1 AS DOUBLE) AS p00, CAST(1 AS DOUBLE) AS p01, CAST(1 AS DOUBLE) AS p11 FROM "
        "(SELECT DISTINCT user_id FROM ev) UNION ALL "
        "SELECT user_id, seq, event_id, f, f + k0 * y, rate + k1 * y, a00 - k0 * h0, a01 - k0 * h1, "
        "a11 - k1 * h1 FROM (SELECT *, h0 / s AS k0, h1 / s AS k1, value - (f + rate) AS y FROM "
        "(SELECT *, a00 + a01 AS h0, a01 + a11 AS h1, a00 + 2 * a01 + a11 + 0.1::DOUBLE AS s FROM "
        "(SELECT e.user_id, e.seq, e.event_id, e.value, t.angle + t.rate AS f, t.rate, "
        "t.p00 + 2 * t.p01 + t.p11 + 0.00001::DOUBLE AS a00, t.p01 + t.p11 AS a01, "
        "t.p11 + 0.00001::DOUBLE AS a11 FROM st t JOIN ev e ON e.user_id = t.user_id AND "
        "e.seq = t.seq + 1))))",
    ],
    "SELECT user_id, event_id, seq AS step, "
    + ", ".join(f"round({c}, 6) AS {c}" for c in ("predicted", "angle", "rate", "p00", "p01", "p11"))
    + " FROM st WHERE seq > 0",
)

MATCHES = select(
    [
        *tree_quantised(), FRAMES,
        cte("firsts", "SELECT frame_id, word_id, min(pos) AS prev_pos FROM q GROUP BY 1, 2"),
    ],
    f"SELECT q.frame_id, q.pos, f.prev_frame_id, p.prev_pos FROM q JOIN fr f USING (frame_id) JOIN firsts "
    f"p ON p.frame_id = f.prev_frame_id WHERE {below('p.word_id', ancestor('q.word_id'))}",
)

BAGS = [*tree_quantised(), *BAG]

RETRIEVE = select(
    [
        *BAGS, FRAMES, SIMILARITY,
        cte("ranked",
            "SELECT a.frame_id, b.seq AS best_seq, s.score, row_number() OVER (PARTITION BY a.frame_id "
            "ORDER BY round(s.score, 12) DESC, b.seq) AS rn FROM fr a JOIN fr b ON b.seq <= a.seq - "
            f"{EXCLUDE_RECENT} JOIN sim s ON s.qf = a.frame_id AND s.f = b.frame_id WHERE "
            "round(s.score, 12) > 0"),
    ],
    "SELECT f.frame_id, f.seq, r.best_seq, coalesce(round(r.score, 6), 0) AS score, "
    "floor(coalesce(round(r.score, 9), 0) * 100) / 100 AS shown FROM fr f LEFT JOIN ranked r ON "
    "r.frame_id = f.frame_id AND r.rn = 1",
)

CLOSURES = [
    *island_rows(),
    cte("bf",
        "SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, time_us) "
        "AS fn FROM isl JOIN (SELECT * FROM rk WHERE rn = 1) USING (query_id, island_id)"),
    cte("used", "SELECT DISTINCT frame_id, word_id FROM q"),
    cte("cov",
        "SELECT b.query_id, u.word_id, max(CASE WHEN "
        + below("u.word_id", ancestor("o.word_id"))
        + " THEN 1 ELSE 0 END) AS hit FROM bf b JOIN used u ON u.frame_id = b.query_id JOIN used o "
        "ON o.frame_id = b.frame_id WHERE b.fn = 1 GROUP BY 1, 2"),
    cte("tt", "SELECT query_id, count(*) AS total, sum(1 - hit) AS uncovered FROM cov GROUP BY 1"),
]

def kmeans(k: int) -> list[str]:
    """Ten attempts with centres drawn by hash, one update each: ``won(attempt)`` and ``fin(attempt, id, pos, d)``."""
    placed = (
        "SELECT attempt, id, pos, d FROM (SELECT c.attempt, v.id, c.pos, round(list_distance(v.v, c.v) * "
        "list_distance(v.v, c.v), 6) AS d, row_number() OVER (PARTITION BY c.attempt, v.id ORDER BY round("
        "list_distance(v.v, c.v) * list_distance(v.v, c.v), 6), c.pos) AS rn FROM {centres} c, vec v) WHERE rn = 1"
    )
    value = BYTES.replace("CAST(e AS", "CAST(x AS").replace("AS INTEGER)", "AS DOUBLE)")
    return [
        cte("vec", f"SELECT vec_id AS id, [{value} for x in embedding] AS v FROM embeddings"),
        cte("c0",
            "SELECT attempt, pos, v FROM (SELECT a.range AS attempt, v.v, row_number() OVER (PARTITION BY a.range ORDER BY "
            "md5(v.id || ':' || a.range || ':0'), v.id) - 1 AS pos FROM vec v, range(10) a) WHERE pos < " + str(k)),
        cte("p0", placed.format(centres="c0")),
        cte("mean",
            "SELECT attempt, pos, list(m ORDER BY j) AS v FROM (SELECT attempt, pos, j, avg(x) AS m FROM (SELECT "
            "p.attempt, p.pos, unnest(range(len(v.v))) AS j, unnest(v.v) AS x FROM p0 p JOIN vec v USING (id)) GROUP BY "
            "1, 2, 3) GROUP BY 1, 2"),
        cte("c1", "SELECT c0.attempt, c0.pos, coalesce(m.v, c0.v) AS v FROM c0 LEFT JOIN mean m USING (attempt, pos)"),
        cte("fin", placed.format(centres="c1")),
        cte("won", "SELECT attempt FROM fin GROUP BY attempt ORDER BY round(sum(d), 3), attempt LIMIT 1"),
    ]


def consensus() -> list[str]:
    """``kept(frame_id, prev_frame_id, pos, prev_pos, inlier)``: draws, models and votes stated pair by pair."""

    def turn(side: str, a: int, b: int, c: int) -> str:
        x, y = (lambda i: f"p{i}.{side}x"), (lambda i: f"p{i}.{side}y")
        return f"(({x(b)} - {x(a)}) * ({y(c)} - {y(a)}) - ({x(c)} - {x(a)}) * ({y(b)} - {y(a)}))"

    corners = ((3, 1, 2), (0, 3, 2), (0, 1, 3), (0, 1, 2))
    areas = ", ".join(f"{turn(s, *c)} AS {s}{i}" for s in "sd" for i, c in enumerate(corners))
    rows = [["p0.dx", "p1.dx", "p2.dx"], ["p0.dy", "p1.dy", "p2.dy"], ["1.0", "1.0", "1.0"]]

    def cross(i: int, c: int) -> str:
        j, k = ((1, 2), (2, 0), (0, 1))[i]
        return (f"(p{j}.sy - p{k}.sy)", f"(p{k}.sx - p{j}.sx)", f"(p{j}.sx * p{k}.sy - p{k}.sx * p{j}.sy)")[c]

    products = ", ".join(f"{row[i]} * 1.0::DOUBLE AS q{r}{i}, {cross(i, r)} AS x{i}{r}" for r, row in enumerate(rows) for i in range(3))
    entries = ", ".join(
        f"(d0 / s0) * q{r}0 * x0{c} + (d1 / s1) * q{r}1 * x1{c} + (d2 / s2) * q{r}2 * x2{c} AS h{3 * r + c}"
        for r in range(3) for c in range(3))
    nonzero = " AND ".join(f"{s}{i} <> 0" for s in "sd" for i in range(4))
    point = ("SELECT vec_id // {f} AS frame_id, CAST(vec_id % {f} AS INTEGER) AS pos, CAST(embedding[-2] AS DOUBLE) * 500 AS x, "
             "CAST(embedding[-1] AS DOUBLE) * 500 AS y FROM embeddings").format(f=FRAME)
    error = ("((h0 * {t}sx + h1 * {t}sy + h2) / (h6 * {t}sx + h7 * {t}sy + h8) - {t}dx) ** 2 + ((h3 * {t}sx + h4 * {t}sy + h5) / "
             "(h6 * {t}sx + h7 * {t}sy + h8) - {t}dy) ** 2").format(t="t.")
    inside = f"coalesce(isfinite({error}) AND {error} < 25, false)"
    return [
        *tree_quantised(), FRAMES,
        cte("firsts", "SELECT frame_id, word_id, min(pos) AS prev_pos FROM q GROUP BY 1, 2"),
        cte("pt", point),
        cte("pr",
            "SELECT q.frame_id, f.prev_frame_id, q.pos, p.prev_pos, a.x AS sx, a.y AS sy, b.x AS dx, b.y AS dy, row_number() OVER "
            "(PARTITION BY q.frame_id ORDER BY q.pos, p.prev_pos) - 1 AS i, count(*) OVER (PARTITION BY q.frame_id) AS n FROM q "
            "JOIN fr f USING (frame_id) JOIN firsts p ON p.frame_id = f.prev_frame_id JOIN pt a ON a.frame_id = q.frame_id AND "
            "a.pos = q.pos JOIN pt b ON b.frame_id = f.prev_frame_id AND b.pos = p.prev_pos WHERE "
            + below("p.word_id", ancestor("q.word_id"))),
        cte("dr",
            "SELECT g.frame_id, t.range AS t, k.range AS k, g.n * k.range // 4 + CAST('0x' || substr(md5(t.range || ':' || k.range "
            "|| ':0'), 1, 8) AS BIGINT) % (g.n * (k.range + 1) // 4 - g.n * k.range // 4) AS i FROM (SELECT DISTINCT frame_id, n "
            f"FROM pr WHERE n >= 4) g, range({TRIALS}) t, range(4) k"),
        cte("pk", "SELECT d.frame_id, d.t, d.k, p.sx, p.sy, p.dx, p.dy FROM dr d JOIN pr p USING (frame_id, i)"),
        cte("ar",
            f"SELECT p0.frame_id, p0.t, {areas}, {products} FROM pk p0 JOIN pk p1 ON p1.frame_id = p0.frame_id AND p1.t = p0.t AND p1.k "
            "= 1 JOIN pk p2 ON p2.frame_id = p0.frame_id AND p2.t = p0.t AND p2.k = 2 JOIN pk p3 ON p3.frame_id = p0.frame_id AND "
            "p3.t = p0.t AND p3.k = 3 WHERE p0.k = 0"),
        cte("md", f"SELECT frame_id, t, {entries} FROM ar WHERE {nonzero}"),
        cte("vt",
            f"SELECT m.frame_id, m.t, sum(CASE WHEN {inside} THEN 1 ELSE 0 END) AS votes FROM md m JOIN pr t USING (frame_id) GROUP BY 1, 2"),
        cte("bm",
            "SELECT m.* FROM md m JOIN (SELECT frame_id, t, row_number() OVER (PARTITION BY frame_id ORDER BY votes DESC, t) AS rn FROM "
            "vt) b ON b.frame_id = m.frame_id AND b.t = m.t AND b.rn = 1"),
        cte("kept",
            f"SELECT t.frame_id, t.prev_frame_id, t.pos, t.prev_pos, CASE WHEN m.t IS NOT NULL AND {inside} THEN 1 ELSE 0 END AS inlier "
            "FROM pr t LEFT JOIN bm m USING (frame_id)"),
    ]


MODEL_BAGS = select(
    [*tree_quantised(), *BAG],
    "SELECT frame_id, word_index, round(weight, 6) AS weight FROM bow",
)


def oracles() -> dict[str, str]:
    cost = "SELECT pos, id, CAST(cost AS DOUBLE) AS cost FROM cc"
    fit_bits = fitted(HAMMING, HAMMING, BITS)
    pair = (
        f"FROM el a JOIN fr f ON f.frame_id = a.id // {FRAME} JOIN el b ON b.id // {FRAME} = "
        f"f.prev_frame_id AND b.id % {FRAME} = a.id % {FRAME} AND b.j = a.j GROUP BY a.id"
    )
    return {
        "src_vocab_text": select([elements(BYTES)], KEYS),
        "vocab_dedup": select(
            [elements(BYTES)],
            "SELECT key, replace(key, '.', ',') AS elements FROM (SELECT DISTINCT key FROM "
            f"({KEYS}))",
        ),
        "src_dense_id": "SELECT user_id, event_id, row_number() OVER (ORDER BY user_id, event_id) - 1 AS "
                        "id FROM events",
        "src_clusters_json": select(assigned(), "SELECT pos AS cluster, id FROM asg"),
        "sink_model_roundtrip": MODEL_BAGS,
        "dist_metrics": select(
            [
                FRAMES,
                cte("el0", "SELECT vec_id AS id, unnest(range(len(embedding))) AS j, unnest(embedding) "
                           "AS e FROM embeddings"),
                cte("el", f"SELECT id, j, {BITS} AS x, {BYTES} AS y FROM el0"),
            ],
            f"SELECT a.id // {FRAME} AS frame_id, CAST(a.id % {FRAME} AS INTEGER) AS pos, sum(CASE WHEN "
            "a.x <> b.x THEN 1 ELSE 0 END) AS hamming, sum(abs(CAST(a.y AS DOUBLE) - b.y)) AS l1, "
            "sum((CAST(a.y AS DOUBLE) - b.y) * (CAST(a.y AS DOUBLE) - b.y)) AS l2sq, "
            "round(sqrt(sum((CAST(a.y AS DOUBLE) - b.y) * (CAST(a.y AS DOUBLE) - b.y))), 6) AS l2, "
            "min(CASE WHEN a.x = b.x THEN 1 ELSE 0 END) AS exact, round(100.0 * sum(CASE WHEN a.y = b.y "
            f"THEN 1 ELSE 0 END) / count(*), 6) AS percent {pair}",
        ),
        "match_bruteforce": select(
            [
                FRAMES, elements(BITS),
                cte("pr",
                    f"SELECT f.frame_id, f.prev_frame_id, CAST(a.id % {FRAME} AS INTEGER) AS pos, CAST(b.id "
                    f"% {FRAME} AS INTEGER) AS prev_pos, sum(CASE WHEN a.x <> b.x THEN 1 ELSE 0 END) AS "
                    "hamming, sum(CASE WHEN a.x = b.x THEN 1.0 ELSE 0 END) * 100 / count(*) AS percent, "
                    f"sqrt(sum((a.x - b.x) * (a.x - b.x))) AS l2 FROM el a JOIN fr f ON f.frame_id = a.id // "
                    f"{FRAME} JOIN el b ON b.id // {FRAME} = f.prev_frame_id AND b.j = a.j GROUP BY f.frame_id, "
                    "f.prev_frame_id, a.id, b.id"),
                cte("rk", "SELECT *, count(*) OVER w AS compared, sum(CASE WHEN hamming = 0 THEN 1 ELSE 0 "
                          "END) OVER w AS equal, row_number() OVER (PARTITION BY frame_id, pos ORDER BY "
                          "hamming, prev_pos) AS rn FROM pr WINDOW w AS (PARTITION BY frame_id, pos)"),
            ],
            "SELECT frame_id, prev_frame_id, pos, prev_pos, compared, equal, hamming, round(percent, 6) AS "
            "percent, round(l2, 6) AS l2 FROM rk WHERE rn = 1",
        ),
        "seed_farthest": select(seeded(), "SELECT pos, id FROM med"),
        "seed_explicit": select(
            [
                elements(BITS), distances(HAMMING), POINTS,
                cte("med", f"SELECT '{ROOT}' AS node_id, row_number() OVER (ORDER BY vec_id DESC) - 1 AS pos, "
                           f"vec_id AS id FROM embeddings ORDER BY vec_id DESC LIMIT {K}"),
                assignment("pts", "med", "asg"),
            ],
            "SELECT pos, count(*) AS members, sum(dist) AS dist FROM asg GROUP BY pos",
        ),
        "kmedoids_assign": select(assigned(), "SELECT id, pos, dist FROM asg"),
        "kmedoids_custom_metric": select(assigned(BYTES, CHEBYSHEV), "SELECT id, pos, dist FROM asg"),
        "kmedoids_check": select(
            assigned(),
            f"SELECT (SELECT count(*) FROM asg) AS placed, (SELECT count(*) FROM embeddings) - {K} AS "
            f"expected, CASE WHEN (SELECT count(*) FROM asg) = (SELECT count(*) FROM embeddings) - {K} "
            "THEN 1 ELSE 0 END AS complete",
        ),
        "cluster_members": select(
            assigned(),
            "SELECT m.pos, m.id AS medoid_id, coalesce(a.id // 4096, 0) AS block, coalesce(string_agg("
            "CAST(a.id AS VARCHAR), ',' ORDER BY a.id), '') AS members, count(a.id) AS n FROM med m LEFT "
            "JOIN asg a USING (pos) GROUP BY 1, 2, 3",
        ),
        "cluster_population": select(
            assigned(),
            "SELECT pos, count(*) AS members, round(count(*) / CAST((SELECT count(*) FROM asg) AS DOUBLE), "
            "6) AS share FROM asg GROUP BY pos",
        ),
        "medoid_cost": select([*assigned(), costs("asg", "cc")], cost),
        "medoid_cost_l1": select([*assigned(BYTES, L1), costs("asg", "cc")], cost),
        "medoid_cost_l2sq": select([*assigned(BYTES, L2SQ), costs("asg", "cc")], cost),
        "kmedoids_update": select(
            [*assigned(), costs("asg", "cc")],
            "SELECT pos, min(id) FILTER (rn = 1) AS id, CAST(min(cost) AS DOUBLE) AS medoid_cost, "
            "CAST(sum(cost) AS DOUBLE) AS all_pairs, count(*) AS members FROM (SELECT *, row_number() OVER "
            "(PARTITION BY pos ORDER BY cost, id) AS rn FROM cc) GROUP BY pos",
        ),
        "kmedoids_fit": select(fit_bits, "SELECT pos, id, 1 AS converged FROM fin"),
        "kmedoids_fit_best": select(fitted(HAMMING, HAMMING, BITS, best=True), "SELECT pos, id FROM fin"),
        "kmedoids_fit_random": select(
            fitted(HAMMING, HAMMING, BITS, opening=RANDOM), "SELECT pos, id FROM fin"
        ),
        "sample_rows": "SELECT vec_id AS id FROM embeddings ORDER BY md5(vec_id || ':7'), vec_id LIMIT 50",
        "kmedoids_fit_euclidean": select(
            [*fitted(L2SQ, L1, BYTES), assignment("pts", "fin", "asg")],
            "SELECT f.pos, f.id, count(a.id) AS members FROM fin f LEFT JOIN asg a USING (pos) GROUP BY 1, 2",
        ),
        "root_mean_descriptor": select(
            [elements(BYTES)],
            "SELECT CAST(j AS INTEGER) AS j, round(avg(sqrt(x)), 6) AS mean FROM el GROUP BY 1",
        ),
        "tree_build": select(tree(), "SELECT node_id, parent_id, pos, depth, id, size, is_leaf FROM nodes"),
        "tree_words": select(tree(), "SELECT word_index, word_id, leaf_id FROM words"),
        "tree_children": select(
            tree(),
            "SELECT parent_id, string_agg(node_id, ',' ORDER BY pos) AS children, count(*) AS vectors FROM "
            "nodes GROUP BY 1",
        ),
        "tree_quantise": select(tree_quantised(), "SELECT frame_id, pos, word_id FROM q"),
        "tree_neighbourhood": select(
            tree(),
            "SELECT a.word_id, b.word_id AS neighbour_id FROM words a JOIN words b ON "
            + below("b.word_id", ancestor("a.word_id")),
        ),
        "word_weights": select(BAGS, "SELECT word_id, round(weight, 6) AS weight FROM wts"),
        "word_onehot": select(
            BAGS,
            "SELECT q.frame_id, q.pos, w.word_index, 1 AS nonzero, round(t.weight, 6) AS weight FROM q JOIN "
            "words w USING (word_id) JOIN wts t USING (word_id)",
        ),
        "bow_frames": select(
            BAGS,
            "SELECT frame_id, word_index, round(weight, 6) AS weight, count(*) OVER (PARTITION BY frame_id) "
            "AS nonzero FROM bow",
        ),
        "bow_similarity": select(
            [*BAGS, FRAMES, SIMILARITY],
            f"SELECT qf AS query_id, f AS frame_id, round(score, 6) AS score FROM sim WHERE f < qf AND "
            f"round(score, 9) > {MIN_SCORE}",
        ),
        "inverted_index": select(
            BAGS,
            "SELECT word_index, frame_id // 4096 AS block, string_agg(CAST(frame_id AS VARCHAR), ',' ORDER "
            "BY frame_id) AS frame_ids, round(sum(weight), 6) AS total FROM bow GROUP BY 1, 2",
        ),
        "retrieve_best": RETRIEVE,
        "frame_lag": "SELECT user_id, row_number() OVER w AS seq, event_id, value, lag(event_id) OVER w AS "
                     "prev_event_id, lag(value) OVER w AS prev_value FROM events WINDOW w AS (PARTITION BY "
                     "user_id ORDER BY ts, event_id)",
        "motion_cumulative": "SELECT user_id, event_id, round(sum(value) OVER w, 4) AS x, round(sum(-value / "
                             "2) OVER w, 4) AS y FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, "
                             "event_id ROWS UNBOUNDED PRECEDING)",
        "keyframes": KEYFRAMES,
        "match_candidates": MATCHES,
        "loop_islands": select(
            island_rows(),
            "SELECT i.query_id, i.frame_id, i.time_us, i.island_id, round(i.score, 6) AS score, "
            "round(r.island_score, 6) AS island_score, r.island_frames, CASE WHEN r.rn = 1 THEN 1 ELSE 0 "
            "END AS is_best FROM isl i JOIN rk r USING (query_id, island_id)",
        ),
        "session_islands": select(
            [
                *scored(),
                cte("gaps", "SELECT *, CASE WHEN time_us - lag(time_us) OVER (PARTITION BY query_id ORDER BY time_us) <= "
                            f"{POOL} THEN 0 ELSE 1 END AS opens FROM sc"),
                cte("ses", "SELECT *, sum(opens) OVER (PARTITION BY query_id ORDER BY time_us) AS s FROM gaps"),
            ],
            f"SELECT query_id, min(time_us) AS start_at, max(time_us) + {POOL} AS end_at, count(*) AS frames, "
            "round(sum(score), 6) AS score FROM ses GROUP BY query_id, s",
        ),
        "loop_closure": select(
            CLOSURES,
            "SELECT b.query_id, b.frame_id, b.island_id, round(b.island_score, 6) AS island_score, "
            "b.island_frames, round(b.score, 6) AS score, t.total, t.uncovered, CASE WHEN t.uncovered = 0 "
            "THEN 1 ELSE 0 END AS closed FROM bf b JOIN tt t USING (query_id) WHERE b.fn = 1",
        ),
        "stream_process_frame": select(
            [
                *CLOSURES,
                cte("firsts", "SELECT frame_id, word_id, min(pos) AS prev_pos FROM q GROUP BY 1, 2"),
                cte("mt",
                    "SELECT q.frame_id, count(*) AS n_matches, string_agg(q.pos || ':' || p.prev_pos, ',' ORDER BY "
                    "q.pos, p.prev_pos) AS matches FROM q JOIN fr f USING (frame_id) JOIN firsts p ON p.frame_id = "
                    f"f.prev_frame_id WHERE {below('p.word_id', ancestor('q.word_id'))} AND q.frame_id NOT IN "
                    "(SELECT frame_id FROM kf) GROUP BY 1"),
            ],
            "SELECT f.frame_id, f.seq, CASE WHEN k.frame_id IS NULL THEN 0 ELSE 1 END AS is_key, round(e.score, 6) "
            "AS expected, coalesce(m.n_matches, 0) AS n_matches, m.matches, b.frame_id AS best_frame, b.island_id, "
            "round(b.island_score, 6) AS island_score, round(b.score, 6) AS score, t.total, t.uncovered, CASE WHEN "
            "t.uncovered = 0 THEN 1 WHEN t.uncovered > 0 THEN 0 END AS closed FROM fr f LEFT JOIN kf k ON "
            "k.frame_id = f.frame_id LEFT JOIN sim e ON e.qf = f.frame_id AND e.f = f.prev_frame_id LEFT JOIN mt m "
            "ON m.frame_id = f.frame_id LEFT JOIN (SELECT * FROM bf WHERE fn = 1) b ON b.query_id = f.frame_id "
            "LEFT JOIN tt t ON t.query_id = f.frame_id",
        ),
        "stream_index": select(
            scored(),
            f"SELECT word_index, seq // {BLOCK_FRAMES} AS block, count(*) AS n_frames, string_agg(CAST(frame_id AS "
            "VARCHAR), ',' ORDER BY seq) AS frame_ids, round(max(weight), 6) AS most, round(sum(weight), 6) AS total "
            "FROM bow JOIN (SELECT frame_id, seq FROM fr JOIN kp USING (seq)) USING (frame_id) GROUP BY 1, 2",
        ),
        "retrieve_blocks": RETRIEVE,
        "neighbour_words": select(
            [
                *tree_quantised(),
                cte("used", "SELECT DISTINCT q.frame_id, q.word_id, w.word_index FROM q JOIN words w USING "
                            "(word_id)"),
            ],
            "SELECT u.frame_id, n.word_id AS neighbour_id, max_by(u.word_id, u.word_index) AS word_id FROM "
            "used u JOIN words n ON " + below("n.word_id", ancestor("u.word_id")) + " GROUP BY 1, 2",
        ),
        "kmeans_baseline": select(
            kmeans(1024), "SELECT CAST(pos AS INTEGER) AS cluster, count(*) AS members FROM fin JOIN won USING (attempt) GROUP BY 1"),
        "kmeans_attempts": select(
            kmeans(2 * K),
            "SELECT CAST(c.attempt AS INTEGER) AS attempt, CAST(c.pos AS INTEGER) AS cluster, count(f.id) AS members, "
            "round(coalesce(sum(f.d), 0), 2) AS dist FROM c0 c JOIN won USING (attempt) LEFT JOIN fin f ON f.attempt = c.attempt AND "
            "f.pos = c.pos GROUP BY 1, 2"),
        "match_consensus": select(
            consensus(), "SELECT frame_id, count(*) AS pairs, CAST(sum(inlier) AS BIGINT) AS tracked FROM kept GROUP BY 1"),
        "match_inliers": select(
            consensus(), "SELECT frame_id, prev_frame_id, pos, prev_pos FROM kept WHERE inlier = 1"),
        "kalman_track": KALMAN,
        # a stream must end with the result of its batch twin
        "stream_keyframes": KEYFRAMES,
        "stream_kalman": KALMAN,
        "stream_prev_match": MATCHES,
        "stream_retrieve": RETRIEVE,
    }
