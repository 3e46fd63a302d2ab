"""SQL for the engine's queries, on the same tables, for another engine (DuckDB) to check them with."""

from __future__ import annotations

from ..config import FEATURES
from .queries import COARSE, CONFIG, FINE

COLS = list(FEATURES)

TX = """tx AS (
  SELECT CASE WHEN l_returnflag = 'R' THEN 'C' ELSE '' END || CAST(o_orderkey AS VARCHAR) AS InvoiceNo, CAST(l_partkey AS VARCHAR) AS StockCode,
         CAST(l_linenumber AS BIGINT) AS LineNo, CAST(l_quantity AS DOUBLE) AS Quantity, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS InvoiceDate,
         l_extendedprice / l_quantity AS UnitPrice, CAST(o_custkey AS VARCHAR) AS CustomerID, n_name AS Country, CAST(l_extendedprice AS DECIMAL(18,2)) AS Revenue
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""
DIRTY = """dirty AS (
  SELECT CASE v WHEN 8 THEN NULL ELSE InvoiceNo END AS InvoiceNo, StockCode, LineNo, CASE v WHEN 3 THEN 0.0 WHEN 4 THEN -Quantity ELSE Quantity END AS Quantity,
         CASE v WHEN 7 THEN 'not a date' WHEN 9 THEN NULL ELSE InvoiceDate END AS InvoiceDate,
         CASE v WHEN 5 THEN CAST('NaN' AS DOUBLE) WHEN 6 THEN NULL ELSE UnitPrice END AS UnitPrice,
         CASE v WHEN 1 THEN NULL WHEN 2 THEN '' ELSE CustomerID END AS CustomerID, Country, Revenue
  FROM (SELECT *, unnest(CASE WHEN CAST(StockCode AS BIGINT) % 40 < 10 THEN [-1, CAST(StockCode AS BIGINT) % 40] ELSE [-1] END) AS v FROM tx))"""


def _clean(source: str, country: str = "") -> str:
    return f"""invoiced AS (SELECT * REPLACE (coalesce(InvoiceNo, 'nan') AS InvoiceNo) FROM {source}),
cancelled AS (SELECT * FROM invoiced WHERE starts_with(InvoiceNo, 'C')),
kept AS (SELECT DISTINCT * FROM invoiced WHERE NOT starts_with(InvoiceNo, 'C') AND CustomerID IS NOT NULL AND CustomerID <> ''
           AND Quantity > 0 AND NOT isnan(Quantity) AND UnitPrice > 0 AND NOT isnan(UnitPrice)),
clean AS (SELECT * REPLACE (TRY_CAST(InvoiceDate AS TIMESTAMP) AS InvoiceDate) FROM kept
          WHERE TRY_CAST(InvoiceDate AS TIMESTAMP) IS NOT NULL{country})"""


PROFILES = """snap AS (SELECT max(InvoiceDate) + INTERVAL 1 DAY AS moment FROM clean),
base AS (SELECT CustomerID, max(InvoiceDate) AS last, count(DISTINCT InvoiceNo) AS frequency, CAST(sum(Revenue) AS DOUBLE) AS monetary,
                count(DISTINCT StockCode) AS product_diversity, count(*) AS lines, count(*) FILTER (isodow(InvoiceDate) >= 6) AS weekend FROM clean GROUP BY 1),
cancels AS (SELECT CustomerID, count(DISTINCT InvoiceNo) AS c FROM cancelled WHERE CustomerID IS NOT NULL GROUP BY 1),
cats AS (SELECT CustomerID, max(n) AS top FROM (SELECT CustomerID, substr(StockCode, 1, 2) AS cat, count(*) AS n FROM clean GROUP BY 1, 2) GROUP BY 1),
profiles AS (
  SELECT b.CustomerID, CAST(date_sub('day', b.last, (SELECT moment FROM snap)) AS DOUBLE) AS recency, CAST(frequency AS DOUBLE) AS frequency, monetary,
         monetary / frequency AS avg_basket, CAST(product_diversity AS DOUBLE) AS product_diversity,
         coalesce(c, 0) / (coalesce(c, 0) + frequency) AS return_rate, weekend / lines AS weekend_ratio, top / lines AS repeat_category_rate
  FROM base b LEFT JOIN cancels USING (CustomerID) JOIN cats USING (CustomerID))"""
ALL = f"WITH RECURSIVE {TX}, {_clean('tx')}, {PROFILES}"


def _each(template: str, columns: list[str] = COLS, by: str = ", ") -> str:
    return by.join(template.replace("@", c).replace("#", str(i)) for i, c in enumerate(columns))


def _rounded(columns: list[str], places: int = 6) -> str:
    return _each(f"round(@, {places}) AS @", columns)


SCALED = f"""buyers AS (SELECT * FROM profiles WHERE frequency >= 2),
bounds AS (SELECT {_each("quantile_cont(@, 0.01) AS lo#, quantile_cont(@, 0.99) AS hi#")} FROM buyers),
capped AS (SELECT CustomerID, {_each("least(greatest(@, lo#), hi#) AS @")} FROM buyers, bounds),
logged AS (SELECT CustomerID, {_each("ln(1 + greatest(@, 0.0)) AS @", COLS[:5])}, {", ".join(COLS[5:])} FROM capped),
ranked AS (SELECT *, row_number() OVER (ORDER BY md5(CustomerID) || CustomerID) AS rn, count(*) OVER () AS n_all FROM logged),
split AS (SELECT *, CASE WHEN rn <= ceil(0.2 * n_all) THEN 'test' ELSE 'train' END AS split FROM ranked),
ranges AS (SELECT {_each("min(@) AS mn#, max(@) AS mx#")} FROM split WHERE split = 'train'),
scaled AS (SELECT CustomerID, split, {_each("CASE WHEN mx# > mn# THEN (@ - mn#) / (mx# - mn#) ELSE 0.0 END AS @")} FROM split, ranges),
train AS (SELECT * FROM scaled WHERE split = 'train')"""


def _units(settings: list[tuple[int, float]]) -> str:
    values = ", ".join(f"({xi}, {tau}::DOUBLE)" for xi, tau in settings)
    return f"""cfg(xi, tau) AS (VALUES {values}),
long AS ({_each("SELECT CustomerID AS id, # AS dim, least(greatest(@, 0.0), 1.0) AS x FROM train", by=" UNION ALL ")}),
np AS (SELECT count(*) AS n FROM train),
bins AS (SELECT id, dim, xi, CAST(greatest(least(floor(round(x * xi, 9)), xi - 1), 0) AS BIGINT) AS cell FROM long, (SELECT DISTINCT xi FROM cfg)),
cells1 AS (SELECT xi, dim, cell, count(*) AS cnt FROM bins GROUP BY 1, 2, 3),
u1 AS (SELECT c.xi, tau, dim AS d1, cell AS c1, cnt, row_number() OVER (PARTITION BY c.xi, tau ORDER BY dim, cell) AS pos
       FROM cells1 c JOIN cfg ON c.xi = cfg.xi, np WHERE cnt >= tau * n),
k2 AS (SELECT a.xi, a.tau, a.d1, a.c1, b.d1 AS d2, b.c1 AS c2, a.pos AS pa, b.pos AS pb FROM u1 a JOIN u1 b ON a.xi = b.xi AND a.tau = b.tau AND a.d1 < b.d1),
cells2 AS (SELECT k.xi, k.d1, k.c1, k.d2, k.c2, count(*) AS cnt FROM (SELECT DISTINCT xi, d1, c1, d2, c2 FROM k2) k
           JOIN bins a ON a.xi = k.xi AND a.dim = k.d1 AND a.cell = k.c1 JOIN bins b ON b.xi = k.xi AND b.dim = k.d2 AND b.cell = k.c2 AND b.id = a.id GROUP BY 1, 2, 3, 4, 5),
u2 AS (SELECT k.*, cnt, row_number() OVER (PARTITION BY k.xi, k.tau ORDER BY pa, pb) AS pos FROM k2 k JOIN cells2 c USING (xi, d1, c1, d2, c2), np WHERE cnt >= tau * n),
met3 AS (SELECT x.xi, x.tau, x.d1, y.c1, least(x.d2, y.d2) AS d2, CASE WHEN x.d2 < y.d2 THEN x.c2 ELSE y.c2 END AS c2, greatest(x.d2, y.d2) AS d3, CASE WHEN x.d2 < y.d2 THEN y.c2 ELSE x.c2 END AS c3,
                min(x.pos) OVER (PARTITION BY x.xi, x.tau, x.d1) AS front, x.pos AS px, y.pos AS py
         FROM u2 x JOIN u2 y ON x.xi = y.xi AND x.tau = y.tau AND x.d1 = y.d1 AND x.d2 <> y.d2 AND x.pos < y.pos),
k3 AS (SELECT m.xi, m.tau, m.d1, m.c1, m.d2, m.c2, m.d3, m.c3, min([front, px, py]) AS place FROM met3 m
       JOIN u2 a ON a.xi = m.xi AND a.tau = m.tau AND a.d1 = m.d1 AND a.c1 = m.c1 AND a.d2 = m.d2 AND a.c2 = m.c2
       JOIN u2 b ON b.xi = m.xi AND b.tau = m.tau AND b.d1 = m.d1 AND b.c1 = m.c1 AND b.d2 = m.d3 AND b.c2 = m.c3
       JOIN u2 c ON c.xi = m.xi AND c.tau = m.tau AND c.d1 = m.d2 AND c.c1 = m.c2 AND c.d2 = m.d3 AND c.c2 = m.c3 GROUP BY 1, 2, 3, 4, 5, 6, 7, 8),
cells3 AS (SELECT k.xi, k.d1, k.c1, k.d2, k.c2, k.d3, k.c3, count(*) AS cnt FROM (SELECT DISTINCT xi, d1, c1, d2, c2, d3, c3 FROM k3) k
           JOIN bins a ON a.xi = k.xi AND a.dim = k.d1 AND a.cell = k.c1 JOIN bins b ON b.xi = k.xi AND b.dim = k.d2 AND b.cell = k.c2 AND b.id = a.id
           JOIN bins c ON c.xi = k.xi AND c.dim = k.d3 AND c.cell = k.c3 AND c.id = a.id GROUP BY 1, 2, 3, 4, 5, 6, 7),
u3 AS (SELECT k.*, cnt, row_number() OVER (PARTITION BY k.xi, k.tau ORDER BY place) AS pos FROM k3 k JOIN cells3 c USING (xi, d1, c1, d2, c2, d3, c3), np WHERE cnt >= tau * n),
units AS (SELECT xi, tau, 1 AS k, [d1] AS dims, [c1] AS cells, cnt, pos FROM u1 UNION ALL SELECT xi, tau, 2, [d1, d2], [c1, c2], cnt, 1000000 + pos FROM u2
          UNION ALL SELECT xi, tau, 3, [d1, d2, d3], [c1, c2, c3], cnt, 2000000 + pos FROM u3)"""


UNIT_BINS = """places AS (SELECT u.xi, u.tau, u.pos, u.k, unnest(u.dims) AS dim, unnest(u.cells) AS cell FROM units u),
inside AS (SELECT p.xi, p.tau, p.pos, b.id FROM places p JOIN bins b ON b.xi = p.xi AND b.dim = p.dim AND b.cell = p.cell GROUP BY p.xi, p.tau, p.pos, p.k, b.id HAVING count(*) = p.k)"""
LINKS = """near AS (SELECT a.xi, a.tau, a.dims, a.pos AS p, b.pos AS q, a.cells AS cells_a, b.cells AS cells_b FROM units a JOIN units b ON a.xi = b.xi AND a.tau = b.tau AND a.dims = b.dims
         WHERE list_sum(list_transform(list_zip(a.cells, b.cells), lambda z: abs(z[1] - z[2]))) = 1)"""
CLUSTERS = f"""{LINKS},
reach(xi, tau, p, q) AS (SELECT xi, tau, pos, pos FROM units UNION SELECT r.xi, r.tau, r.p, n.q FROM reach r JOIN near n ON n.xi = r.xi AND n.tau = r.tau AND n.p = r.q),
comps AS (SELECT xi, tau, p AS pos, min(q) AS comp FROM reach GROUP BY 1, 2, 3),
firsts AS (SELECT xi, tau, dims, min(pos) AS front FROM units GROUP BY 1, 2, 3),
heads AS (SELECT c.xi, c.tau, c.comp, row_number() OVER (PARTITION BY c.xi, c.tau ORDER BY u.k, f.front, c.comp) - 1 AS cluster_id
          FROM (SELECT DISTINCT xi, tau, comp FROM comps) c JOIN units u ON u.xi = c.xi AND u.tau = c.tau AND u.pos = c.comp JOIN firsts f ON f.xi = u.xi AND f.tau = u.tau AND f.dims = u.dims),
clustered AS (SELECT u.*, h.cluster_id FROM units u JOIN comps USING (xi, tau, pos) JOIN heads h ON h.xi = u.xi AND h.tau = u.tau AND h.comp = comps.comp),
clusters AS (SELECT xi, tau, cluster_id, any_value(k) AS k, any_value(dims) AS dims, count(*) AS n_units, sum(cnt) AS size FROM clustered GROUP BY 1, 2, 3)"""
LABELS = f"""{UNIT_BINS},
member AS (SELECT DISTINCT i.xi, i.tau, i.id, c.cluster_id, c.k FROM inside i JOIN clustered c USING (xi, tau, pos)),
labels AS (SELECT g.xi, g.tau, t.CustomerID, coalesce(l.cluster_id, -1) AS cluster_id FROM cfg g, train t LEFT JOIN
           (SELECT xi, tau, id, arg_min(cluster_id, [-k, cluster_id]) AS cluster_id FROM member GROUP BY 1, 2, 3) l ON l.xi = g.xi AND l.tau = g.tau AND l.id = t.CustomerID)"""
NAMES = "[" + ", ".join(f"'{c}'" for c in COLS) + "]"
MEANS = f"means AS (SELECT m.xi, m.tau, m.cluster_id, {_each('avg(least(greatest(@, 0.0), 1.0)) AS @')} FROM member m JOIN train ON CustomerID = id GROUP BY 1, 2, 3)"
#: Thresholds and names.
BUSINESS = """CASE WHEN list_contains(names, 'frequency') AND list_contains(names, 'monetary') AND frequency > 0.6 AND monetary > 0.6 THEN 'VIP - Mua nhieu, chi tieu cao'
  WHEN list_contains(names, 'frequency') AND list_contains(names, 'monetary') AND frequency < 0.3 THEN 'One-time buyer'
  WHEN list_contains(names, 'recency') AND list_contains(names, 'weekend_ratio') THEN 'Seasonal / Weekend shopper'
  WHEN list_contains(names, 'repeat_category_rate') AND list_contains(names, 'frequency') THEN 'Brand-loyal customer'
  WHEN list_contains(names, 'product_diversity') AND list_contains(names, 'avg_basket') THEN 'Explorer - Thich da dang san pham'
  WHEN list_contains(names, 'return_rate') AND return_rate > 0.4 THEN 'High-return risk' ELSE 'General cluster' END"""
DESCRIBED = f"""boxes AS (SELECT xi, tau, cluster_id, dim, min(cell) AS lo, max(cell) + 1 AS hi FROM
  (SELECT xi, tau, cluster_id, unnest(dims) AS dim, unnest(cells) AS cell FROM clustered) GROUP BY 1, 2, 3, 4),
texts AS (SELECT xi, tau, cluster_id, string_agg(({NAMES})[dim + 1] || ' in [' || printf('%.2f', lo / xi) || ', ' || printf('%.2f', hi / xi) || ']', ' AND ' ORDER BY dim) AS description FROM boxes GROUP BY 1, 2, 3),
{MEANS},
described AS (SELECT c.*, t.description, list_transform(c.dims, lambda i: ({NAMES})[i + 1]) AS names, m.* EXCLUDE (xi, tau, cluster_id) FROM clusters c JOIN texts t USING (xi, tau, cluster_id) JOIN means m USING (xi, tau, cluster_id)),
business AS (SELECT *, {BUSINESS} AS business_label FROM described)"""
COVER = "cover AS (SELECT dims, any_value(k) AS k, count(*) AS n_clusters, max(size / n) AS coverage, min(cluster_id) AS pos FROM clusters, np GROUP BY dims)"


def _fit(settings: list[tuple[int, float]], *more: str) -> str:
    return ", ".join([ALL, SCALED, _units(settings), *more])


_TEXT = "array_to_string(@, ',') AS @"
_POINTS = f"pts AS (SELECT t.*, cluster_id FROM train t JOIN labels USING (CustomerID) WHERE cluster_id >= 0), centre AS (SELECT cluster_id, count(*) AS n, {_each('avg(@) AS c#')} FROM pts GROUP BY 1)"
_APART = _each("(a.@ - b.@) * (a.@ - b.@)", by=" + ")
_FROM_CENTRE = _each("(@ - c#) * (@ - c#)", by=" + ")
_VOTES = """vote AS (SELECT p, arg_min(y, [-n, y]) AS mapped FROM tab GROUP BY 1),
classes AS (SELECT y AS c FROM tab UNION SELECT mapped FROM vote),
confusion AS (SELECT a.c AS y, b.c AS mapped, CAST(coalesce(sum(n), 0) AS BIGINT) AS n FROM classes a CROSS JOIN classes b
              LEFT JOIN (SELECT y, mapped, n FROM tab JOIN vote USING (p)) t ON t.y = a.c AND t.mapped = b.c GROUP BY 1, 2)"""
_KNOWN = f"""known AS (SELECT vec_id, CAST(label AS BIGINT) AS y, CAST(CASE WHEN embedding[1] < 0 AND embedding[2] < 0 THEN -1
  ELSE CASE WHEN CAST(embedding[1] AS DOUBLE) > 0.05 THEN 2 ELSE 0 END + CASE WHEN CAST(embedding[2] AS DOUBLE) > 0.05 THEN 1 ELSE 0 END END AS BIGINT) AS p FROM embeddings),
tab AS (SELECT y, p, count(*) AS n FROM known GROUP BY 1, 2), {_VOTES}"""
_SUPERVISED = """per AS (SELECT c, (SELECT sum(n) FROM confusion WHERE y = c) AS support, (SELECT sum(n) FROM confusion WHERE mapped = c) AS predicted, (SELECT sum(n) FROM confusion WHERE mapped = c AND y = c) AS tp FROM classes),
pr AS (SELECT *, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0.0 END AS p, CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS r FROM per WHERE support > 0 OR predicted > 0),
f AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END AS f FROM pr),
supervised AS (SELECT sum(tp) / sum(support) AS accuracy, avg(p) AS precision_macro, avg(r) AS recall_macro, avg(f) AS f1_macro, sum(f * support) / sum(support) AS f1_weighted FROM f)"""
_AGREEMENT = """t AS (SELECT sum(n)::DOUBLE AS total FROM tab), ys AS (SELECT y, sum(n)::DOUBLE AS a FROM tab GROUP BY 1), ps AS (SELECT p, sum(n)::DOUBLE AS b FROM tab GROUP BY 1),
mi AS (SELECT sum(n / total * ln(n * total / (a * b))) AS mi, sum(n * (n - 1) / 2.0) AS same FROM tab JOIN ys USING (y) JOIN ps USING (p), t),
hy AS (SELECT -sum(a / total * ln(a / total)) AS hy, sum(a * (a - 1) / 2) AS pa FROM ys, t), hp AS (SELECT -sum(b / total * ln(b / total)) AS hp, sum(b * (b - 1) / 2) AS pb FROM ps, t),
agreement AS (SELECT (same - pa * pb / (total * (total - 1) / 2)) / ((pa + pb) / 2 - pa * pb / (total * (total - 1) / 2)) AS ari, mi / ((hy + hp) / 2) AS nmi, mi / hy AS homogeneity,
       mi / hp AS completeness, 2 * (mi / hy) * (mi / hp) / (mi / hy + mi / hp) AS v_measure FROM mi, hy, hp, t)"""


def _indices(keys: str = "", columns: list[str] = COLS) -> str:
    """Silhouette, Davies-Bouldin and Calinski-Harabasz indices of pts (CustomerID, cluster_id, columns), for each of keys; no row with fewer than two clusters."""
    each = lambda t, by=", ": _each(t, columns, by)
    same = "".join(f"a.{k} = b.{k} AND " for k in keys.split(", ") if k)
    own = "".join(f"a.{k}, " for k in keys.split(", ") if k)
    using = f"USING ({keys}cluster_id)"
    group = lambda extra="": f"GROUP BY {keys}{extra}".rstrip(", ") if keys or extra else ""
    join = f"JOIN {{}} USING ({keys.rstrip(', ')})" if keys else "CROSS JOIN {}"
    return f"""centre AS (SELECT {keys}cluster_id, count(*) AS n, {each("avg(@) AS c#")} FROM pts {group("cluster_id")}),
dist AS (SELECT {own}a.CustomerID AS id, a.cluster_id AS own, b.cluster_id AS other, sum(sqrt({each("(a.@ - b.@) * (a.@ - b.@)", " + ")})) AS total, count(*) AS n FROM pts a JOIN pts b ON {same}true GROUP BY ALL),
ab AS (SELECT {keys}id, own, max(CASE WHEN own = other THEN total / greatest(n - 1, 1) END) AS a, max(CASE WHEN own = other THEN n END) AS size, min(CASE WHEN own <> other THEN total / n END) AS b FROM dist {group("id, own")}),
sil AS (SELECT {keys}avg(CASE WHEN size > 1 AND greatest(a, b) > 0 THEN (b - a) / greatest(a, b) ELSE 0.0 END) AS silhouette, count(DISTINCT own) AS k FROM ab {group()}),
spread AS (SELECT {keys}cluster_id, avg(sqrt({each("(@ - c#) * (@ - c#)", " + ")})) AS s, sum({each("(@ - c#) * (@ - c#)", " + ")}) AS w FROM pts JOIN centre {using} {group("cluster_id")}),
cs AS (SELECT * FROM centre JOIN spread {using}),
worst AS (SELECT {own}a.cluster_id, max((a.s + b.s) / sqrt({each("(a.c# - b.c#) * (a.c# - b.c#)", " + ")})) AS worst FROM cs a JOIN cs b ON {same}a.cluster_id <> b.cluster_id GROUP BY ALL),
dbi AS (SELECT {keys}avg(worst) AS davies_bouldin FROM worst {group()}),
middle AS (SELECT {keys}count(*) AS m, {each("avg(@) AS m#")} FROM pts {group()}),
chi AS (SELECT {keys}sum(n * ({each("(c# - m#) * (c# - m#)", " + ")})) * (max(m) - count(*)) / (sum(w) * (count(*) - 1)) AS calinski_harabasz FROM cs {join.format("middle")} {group()}),
indices AS (SELECT {keys}silhouette, davies_bouldin, calinski_harabasz FROM sil {join.format("dbi")} {join.format("chi")} WHERE k > 1)"""


_NEAR = f"closeby AS (SELECT a.CustomerID AS a, b.CustomerID AS b FROM train a JOIN train b ON a.CustomerID <> b.CustomerID WHERE sqrt({_APART}) <= 0.5)"


def oracle_sql() -> dict[str, str]:
    dirty = f"WITH {TX}, {DIRTY}, {_clean('dirty')}"
    fine = lambda *more: _fit([FINE], *more)
    coarse = lambda *more: _fit([COARSE], CLUSTERS, LABELS, *more)
    all_grid = [(xi, tau) for xi in CONFIG.xi_grid for tau in CONFIG.tau_grid]
    searched = f"""{_fit(all_grid, CLUSTERS, LABELS)}, pts AS (SELECT l.xi, l.tau, l.cluster_id, t.* FROM labels l JOIN train t USING (CustomerID) WHERE l.cluster_id >= 0),
{_indices("xi, tau, ")},
used AS (SELECT xi, tau, count(DISTINCT CASE WHEN cluster_id >= 0 THEN cluster_id END) AS n_clusters, count(*) FILTER (cluster_id < 0) AS n_noise, round(avg(CASE WHEN cluster_id >= 0 THEN 1.0 ELSE 0.0 END), 3) AS coverage FROM labels GROUP BY 1, 2),
grid AS (SELECT u.xi, u.tau, n_clusters, n_noise, coverage, round(silhouette, 4) AS silhouette, round(davies_bouldin, 4) AS davies_bouldin, round(calinski_harabasz, 1) AS calinski_harabasz FROM used u LEFT JOIN indices USING (xi, tau)),
scores AS (SELECT *, CASE WHEN silhouette IS NULL OR n_clusters < {CONFIG.min_clusters} OR coverage < {CONFIG.min_coverage} THEN -1e9
      ELSE silhouette - 0.04 * greatest(0, n_clusters - {CONFIG.max_clusters}) - 0.5 * (1 - coverage) - 0.12 * coalesce(davies_bouldin, 0) END AS quality_score FROM grid)"""
    predicted = f"""pos_ AS (SELECT u.cluster_id, u.k, u.pos, u.xi, unnest(u.dims) AS dim, unnest(u.cells) AS cell, list_max(u.dims) AS last FROM clustered u),
xs AS ({_each("SELECT CustomerID AS id, # AS dim, round(least(greatest(@, 0.0), 1.0) * XI, 9) AS r FROM scaled WHERE SPLIT", by=" UNION ALL ")}),
hit AS (SELECT x.id, p.cluster_id, p.k, p.pos FROM pos_ p JOIN xs x ON x.dim = p.dim AND x.r >= p.cell AND (x.r < p.cell + 1 OR (p.dim = p.last AND x.r = p.cell + 1)) GROUP BY 1, 2, 3, 4 HAVING count(*) = p.k),
best AS (SELECT id, arg_min(cluster_id, [-k, cluster_id]) AS cluster_id FROM hit GROUP BY 1)"""
    at = lambda xi, split: predicted.replace("XI", str(xi)).replace("SPLIT", f"split = '{split}'")
    dbscan = lambda eps: f"""closeby AS (SELECT a.CustomerID AS a, b.CustomerID AS b FROM train a JOIN train b ON a.CustomerID <> b.CustomerID WHERE sqrt({_APART}) <= {eps}),
core AS (SELECT a AS id FROM closeby GROUP BY 1 HAVING count(*) >= 4), links AS (SELECT a, b FROM closeby WHERE a IN (SELECT id FROM core) AND b IN (SELECT id FROM core)),
least_(id, comp) AS (SELECT id, id FROM core UNION SELECT l.b, r.comp FROM least_ r JOIN links l ON l.a = r.id AND r.comp < l.b),
comp AS (SELECT id, min(comp) AS comp FROM least_ GROUP BY 1), roots AS (SELECT comp, row_number() OVER (ORDER BY comp) - 1 AS cluster FROM (SELECT DISTINCT comp FROM comp)),
own AS (SELECT id, cluster FROM comp JOIN roots USING (comp)), border AS (SELECT a AS id, min(cluster) AS cluster FROM closeby JOIN own ON own.id = b GROUP BY 1),
dblabels AS (SELECT CustomerID, coalesce(o.cluster, b.cluster, -1) AS cluster_id FROM train LEFT JOIN own o ON o.id = CustomerID LEFT JOIN border b ON b.id = CustomerID)"""  # noqa: E731
    made = lambda labels: f"pts AS (SELECT t.*, cluster_id FROM train t JOIN {labels} USING (CustomerID) WHERE cluster_id >= 0), {_indices()}"
    of_dbscan = lambda eps: f"SELECT 'DBSCAN' AS algorithm, 'eps={eps}, min_samples=5' AS params, silhouette FROM ({ALL}, {SCALED}, {dbscan(eps)}, {made('dblabels')} SELECT silhouette FROM indices)"
    whole_known = "known2 AS (SELECT k.*, CAST(embedding[1] AS DOUBLE) AS x0, CAST(embedding[2] AS DOUBLE) AS x1 FROM known k JOIN embeddings USING (vec_id)), pts AS (SELECT vec_id AS CustomerID, p AS cluster_id, x0, x1 FROM known2 WHERE p >= 0)"
    synthetic = f"""WITH RECURSIVE h AS (SELECT range AS id, unnest(range(8)) AS i FROM range(200)),
u AS (SELECT id, i, CAST(('0x' || substr(md5(CAST(id AS VARCHAR) || '-' || CAST(i AS VARCHAR)), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE AS v FROM h),
train AS (SELECT CAST(id AS VARCHAR) AS CustomerID, CAST(id < 60 AS BIGINT) AS y, {_each("max(CASE WHEN i = # THEN CASE WHEN id < 60 AND i < 2 THEN (CASE i WHEN 0 THEN 0.6::DOUBLE ELSE 0.7::DOUBLE END) + 0.2::DOUBLE * v ELSE v END END) AS @")} FROM u GROUP BY id),
{_units([FINE])}, {CLUSTERS}, {LABELS}, found AS (SELECT CustomerID, y, cluster_id AS p FROM labels JOIN train USING (CustomerID))"""
    out = {
        "clean_transactions": f"{dirty} SELECT InvoiceNo, StockCode, LineNo, Quantity, strftime(InvoiceDate, '%Y-%m-%d %H:%M:%S') AS InvoiceDate, round(UnitPrice, 8) AS UnitPrice, CustomerID, Country, CAST(Revenue AS DOUBLE) AS Revenue FROM clean",
        "cancellations": f"{dirty} SELECT coalesce(CustomerID, 'none') AS CustomerID, count(*) AS n_rows, count(DISTINCT InvoiceNo) AS n_invoices FROM cancelled GROUP BY 1",
        "cleaning_funnel": f"""{dirty},
s1 AS (SELECT * FROM invoiced WHERE NOT starts_with(InvoiceNo, 'C')), s2 AS (SELECT * FROM s1 WHERE CustomerID <> ''), s3 AS (SELECT * FROM s2 WHERE Quantity > 0 AND NOT isnan(Quantity)),
s4 AS (SELECT * FROM s3 WHERE UnitPrice > 0 AND NOT isnan(UnitPrice)), s5 AS (SELECT DISTINCT * FROM s4), s6 AS (SELECT * FROM s5 WHERE TRY_CAST(InvoiceDate AS TIMESTAMP) IS NOT NULL), s7 AS (SELECT * FROM s6 WHERE Country = 'NATION_7')
SELECT CAST(0 AS BIGINT) AS step_no, 'loaded' AS step, count(*) AS n_rows FROM dirty UNION ALL SELECT 1, 'purchases', count(*) FROM s1 UNION ALL SELECT 2, 'with_customer', count(*) FROM s2
UNION ALL SELECT 3, 'positive_quantity', count(*) FROM s3 UNION ALL SELECT 4, 'positive_price', count(*) FROM s4 UNION ALL SELECT 5, 'distinct', count(*) FROM s5 UNION ALL SELECT 6, 'with_date', count(*) FROM s6 UNION ALL SELECT 7, 'country', count(*) FROM s7""",
        "clean_summary": f"{dirty} SELECT count(*) AS n_rows, count(DISTINCT CustomerID) AS n_customers, strftime(min(InvoiceDate), '%Y-%m-%d') AS first_date, strftime(max(InvoiceDate), '%Y-%m-%d') AS last_date FROM clean",
        "country_filter": f"""WITH {TX}, {_clean("tx", " AND Country = 'NATION_7'")} SELECT Country, count(*) AS n_rows, CAST(sum(Revenue) AS DOUBLE) AS revenue FROM clean GROUP BY 1""",
        "sheet_union": f"WITH {TX} SELECT substr(InvoiceDate, 1, 4) AS year, count(*) AS n_rows, count(CASE WHEN InvoiceDate < '1998' THEN LineNo END) AS n_lines, count(DISTINCT CustomerID) AS n_customers FROM tx GROUP BY 1",
        "repeat_buyers": f"{ALL} SELECT frequency, count(*) AS n FROM profiles WHERE frequency >= 5 GROUP BY 1",
        "top_category": f"{ALL} SELECT CustomerID, category, n FROM (SELECT *, row_number() OVER (PARTITION BY CustomerID ORDER BY n DESC, category) AS r FROM (SELECT CustomerID, substr(StockCode, 1, 2) AS category, count(*) AS n FROM clean GROUP BY 1, 2)) WHERE r = 1",
        "event_recency": "WITH e AS (SELECT user_id, max(ts) AS last FROM events GROUP BY 1) SELECT user_id, date_sub('day', last, (SELECT max(last) + INTERVAL 1 DAY FROM e)) AS recency FROM e",
        "event_weekend": "SELECT event_type, round(avg(CASE WHEN isodow(ts) >= 6 THEN 1.0 ELSE 0.0 END), 6) AS weekend_ratio FROM events GROUP BY 1",
        "feature_stats": f"{ALL} {_each('''SELECT '@' AS feature, round(avg(@), 4) AS mean, round(stddev_samp(@), 4) AS std, round(min(@), 4) AS min, round(max(@), 4) AS max FROM profiles''', by=' UNION ALL ')}",
        "feature_skew": f"{ALL} {_each('''SELECT '@' AS feature, round(skewness(@), 4) AS skewness, abs(skewness(@)) > 1 AS needs_log FROM profiles''', by=' UNION ALL ')}",
        "feature_corr": f"{ALL} " + " UNION ALL ".join(f"SELECT '{a}' AS feature_1, '{b}' AS feature_2, " + ("1.0" if a == b else f"round(corr({a}, {b}), 6)") + " AS r FROM " + ("(SELECT 1)" if a == b else "profiles") for a in COLS for b in COLS),
        "feature_histogram": f"{ALL} {_each('''SELECT '@' AS feature, CAST(least(CASE WHEN hi > lo THEN floor(round((@ - lo) / (hi - lo) * 40, 9)) ELSE 0 END, 39) AS BIGINT) AS bin, count(*) AS n FROM profiles, (SELECT min(@) AS lo, max(@) AS hi FROM profiles) GROUP BY 1, 2''', by=' UNION ALL ')}",
        "feature_quartiles": f"{ALL} {_each('''SELECT '@' AS feature, round(quantile_cont(@, 0.25), 6) AS q1, round(quantile_cont(@, 0.5), 6) AS median, round(quantile_cont(@, 0.75), 6) AS q3 FROM profiles''', by=' UNION ALL ')}",
        "winsor_bounds": f"{ALL}, {SCALED} {_each('''SELECT '@' AS feature, round(lo#, 6) AS lo, round(hi#, 6) AS hi FROM bounds''', by=' UNION ALL ')}",
        "winsorized": f"{ALL}, {SCALED} SELECT CustomerID, {_rounded(COLS)} FROM capped",
        "log_features": f"{ALL} SELECT CustomerID, {_each('round(ln(1 + greatest(@, 0.0)), 6) AS @', COLS[:5])} FROM profiles",
        "split_counts": f"{ALL}, {SCALED} SELECT split, count(*) AS n, min(CustomerID) AS first_id, max(CustomerID) AS last_id FROM split GROUP BY 1",
        "scaler_fit": f"{ALL}, {SCALED} {_each('''SELECT '@' AS feature, round(mn#, 6) AS lo, round(mx#, 6) AS hi FROM ranges''', by=' UNION ALL ')}",
        "scaled_features": f"{ALL}, {SCALED} SELECT CustomerID, split, {_rounded(COLS)} FROM scaled",
        "grid_cells": f"{fine()} SELECT CAST(dim AS BIGINT) AS dim, cell, cnt FROM cells1",
        "candidates_2d": f"{fine()} SELECT d1 || ',' || d2 AS dims, c1 || ',' || c2 AS cells FROM k2",
        "candidates_3d_pruned": f"{fine()} SELECT d1 || ',' || d2 || ',' || d3 AS dims, c1 || ',' || c2 || ',' || c3 AS cells FROM k3",
        "unit_adjacency": f"{fine(LINKS)} SELECT array_to_string(dims, ',') AS dims, array_to_string(cells_a, ',') AS cells_1, array_to_string(cells_b, ',') AS cells_2 FROM near WHERE cells_a < cells_b",
        "unit_components": f"{fine(CLUSTERS)} SELECT cluster_id, {_each(_TEXT, ['dims', 'cells'])}, cnt FROM clustered",
        "clusters": f"{fine(CLUSTERS, LABELS, DESCRIBED)} SELECT cluster_id, CAST(k AS BIGINT) AS k_dim, array_to_string(dims, ',') AS dims, n_units, CAST(size AS BIGINT) AS size, round(size / n, 6) AS coverage, description FROM business, np",
        "cluster_members": f"{fine(CLUSTERS, LABELS)} SELECT cluster_id, count(*) AS n, min(id) AS first_id, max(id) AS last_id FROM member GROUP BY 1",
        "cluster_profiles": f"{fine(CLUSTERS, LABELS, DESCRIBED)} SELECT cluster_id, CAST(size AS BIGINT) AS size, {_rounded(COLS)} FROM business",
        "cluster_descriptions": f"{fine(CLUSTERS, LABELS, DESCRIBED)} SELECT cluster_id, CAST(k AS BIGINT) AS k_dim, array_to_string(names, ' & ') AS subspace, CAST(size AS BIGINT) AS size, round(size / n * 100, 1) AS coverage_pct, description, business_label FROM business, np",
        "subspace_coverage": f"{fine(CLUSTERS, COVER)} SELECT array_to_string(list_transform(dims, lambda i: ({NAMES})[i + 1]), ' & ') AS subspace, CAST(k AS BIGINT) AS dimensions, n_clusters, round(coverage, 6) AS coverage FROM cover",
        "subspace_heatmap": f"{fine(CLUSTERS, COVER)}, names AS (SELECT unnest({NAMES}) AS name, unnest(range({len(COLS)})) AS i) SELECT a.name AS dim_1, b.name AS dim_2, coalesce(n_clusters, 0) AS n_clusters, round(coalesce(coverage, 0.0), 6) AS coverage FROM names a CROSS JOIN names b LEFT JOIN cover ON k = 2 AND dims[1] = least(a.i, b.i) AND dims[2] = greatest(a.i, b.i) AND a.i <> b.i",
        "heatmap_pivot": f"{fine(CLUSTERS, COVER)}, names AS (SELECT unnest({NAMES}) AS name, unnest(range({len(COLS)})) AS i) SELECT a.name AS dim_1, {_each('CAST(coalesce(max(CASE WHEN least(a.i, #) = dims[1] AND greatest(a.i, #) = dims[2] THEN n_clusters END), 0) AS DOUBLE) AS @')} FROM names a LEFT JOIN cover ON k = 2 GROUP BY 1",
        "top_subspaces": f"{fine(CLUSTERS, COVER)} SELECT array_to_string(list_transform(dims, lambda i: ({NAMES})[i + 1]), ' & ') AS subspace, n_clusters, round(coverage, 6) AS coverage FROM cover WHERE k = 2 ORDER BY cover.coverage DESC, pos LIMIT 2",
        "labels": f"{fine(CLUSTERS, LABELS)} SELECT CustomerID, cluster_id FROM labels",
        "coverage_noise": f"{coarse()} SELECT count(*) AS n_points, count(*) FILTER (cluster_id = -1) AS n_noise, round(avg(CASE WHEN cluster_id >= 0 THEN 1.0 ELSE 0.0 END), 6) AS coverage, count(DISTINCT CASE WHEN cluster_id >= 0 THEN cluster_id END) AS n_clusters FROM labels",
        "silhouette": f"""{coarse(_POINTS)}, dist AS (SELECT a.CustomerID AS id, a.cluster_id AS own, b.cluster_id AS other, sum(sqrt({_APART})) AS total, count(*) AS n FROM pts a CROSS JOIN pts b GROUP BY 1, 2, 3),
ab AS (SELECT id, own, max(CASE WHEN own = other THEN total / greatest(n - 1, 1) END) AS a, max(CASE WHEN own = other THEN n END) AS size, min(CASE WHEN own <> other THEN total / n END) AS b FROM dist GROUP BY 1, 2)
SELECT own AS cluster_id, count(*) AS n, round(avg(CASE WHEN size > 1 AND greatest(a, b) > 0 THEN (b - a) / greatest(a, b) ELSE 0.0 END), 6) AS silhouette FROM ab GROUP BY 1""",
        "davies_bouldin": f"""{coarse(_POINTS)}, spread AS (SELECT cluster_id, avg(sqrt({_FROM_CENTRE})) AS s FROM pts JOIN centre USING (cluster_id) GROUP BY 1), cs AS (SELECT * FROM centre JOIN spread USING (cluster_id))
SELECT round(avg(worst), 5) AS davies_bouldin FROM (SELECT a.cluster_id, max((a.s + b.s) / sqrt({_each('(a.c# - b.c#) * (a.c# - b.c#)', by=' + ')})) AS worst FROM cs a JOIN cs b ON a.cluster_id <> b.cluster_id GROUP BY 1)""",
        "calinski_harabasz": f"""{coarse(_POINTS)}, whole AS (SELECT count(*) AS m, {_each('avg(@) AS m#')} FROM pts), within AS (SELECT sum({_FROM_CENTRE}) AS w FROM pts JOIN centre USING (cluster_id)),
between_ AS (SELECT sum(n * ({_each('(c# - m#) * (c# - m#)', by=' + ')})) AS b, count(*) AS k FROM centre, whole) SELECT round(b * (m - k) / (w * (k - 1)), 3) AS calinski_harabasz FROM between_, within, whole""",
        "predict_scores": f"""{fine(CLUSTERS)}, pos_ AS (SELECT u.cluster_id, u.k, u.pos, u.xi, unnest(u.dims) AS dim, unnest(u.cells) AS cell, list_max(u.dims) AS last FROM clustered u),
xs AS ({_each("SELECT CustomerID AS id, # AS dim, round(least(greatest(@, 0.0), 1.0) * 8, 9) AS r FROM scaled", by=" UNION ALL ")}),
hit AS (SELECT x.id, p.cluster_id, p.k, p.pos FROM pos_ p JOIN xs x ON x.dim = p.dim AND x.r >= p.cell AND (x.r < p.cell + 1 OR (p.dim = p.last AND x.r = p.cell + 1)) GROUP BY 1, 2, 3, 4 HAVING count(*) = p.k),
best AS (SELECT id, arg_min(cluster_id, [-k, cluster_id]) AS cluster_id FROM hit GROUP BY 1)
SELECT CustomerID, split, coalesce(cluster_id, -1) AS cluster_id FROM scaled LEFT JOIN best ON id = CustomerID""",
        "test_distribution": f"""{coarse(DESCRIBED)}, pos_ AS (SELECT u.cluster_id, u.k, u.pos, u.xi, unnest(u.dims) AS dim, unnest(u.cells) AS cell, list_max(u.dims) AS last FROM clustered u),
xs AS ({_each("SELECT CustomerID AS id, # AS dim, round(least(greatest(@, 0.0), 1.0) * 12, 9) AS r FROM scaled WHERE split = 'test'", by=" UNION ALL ")}),
hit AS (SELECT x.id, p.cluster_id, p.k, p.pos FROM pos_ p JOIN xs x ON x.dim = p.dim AND x.r >= p.cell AND (x.r < p.cell + 1 OR (p.dim = p.last AND x.r = p.cell + 1)) GROUP BY 1, 2, 3, 4 HAVING count(*) = p.k),
best AS (SELECT id, arg_min(cluster_id, [-k, cluster_id]) AS cluster_id FROM hit GROUP BY 1), got AS (SELECT coalesce(cluster_id, -1) AS cluster_id FROM scaled LEFT JOIN best ON id = CustomerID WHERE split = 'test')
SELECT g.cluster_id, count(*) AS count, coalesce(min(business_label), 'Noise') AS label FROM got g LEFT JOIN business b USING (cluster_id) GROUP BY 1""",
        "contingency_table": f"WITH {_KNOWN} SELECT y, p, n FROM tab",
        "majority_vote": f"WITH {_KNOWN} SELECT p, mapped FROM vote",
        "confusion_matrix": f"WITH {_KNOWN} SELECT y, mapped, n FROM confusion",
        "supervised_scores": f"WITH {_KNOWN}, {_SUPERVISED} SELECT {', '.join(f'round({c}, 6) AS {c}' for c in ('accuracy', 'precision_macro', 'recall_macro', 'f1_macro', 'f1_weighted'))} FROM supervised",
        "agreement_scores": f"WITH {_KNOWN}, {_AGREEMENT} SELECT {', '.join(f'round({c}, 6) AS {c}' for c in ('ari', 'nmi', 'homogeneity', 'completeness', 'v_measure'))} FROM agreement",
        "intrinsic_metrics": f"{coarse(made('labels'))} SELECT round(silhouette, 5) AS silhouette, round(davies_bouldin, 5) AS davies_bouldin, round(calinski_harabasz, 3) AS calinski_harabasz FROM indices",
        "aligned_labels": f"WITH {_KNOWN} SELECT vec_id, y, p, mapped FROM known JOIN vote USING (p)",
        "evaluation": f"""WITH {_KNOWN}, {whole_known}, {_indices(columns=["x0", "x1"])}, {_SUPERVISED}, {_AGREEMENT}
SELECT (SELECT count(DISTINCT p) FROM known WHERE p >= 0) AS n_clusters, round((SELECT 100.0 * count(*) FILTER (p = -1) / count(*) FROM known), 5) AS noise_pct, round(silhouette, 5) AS silhouette, round(davies_bouldin, 5) AS davies_bouldin, round(calinski_harabasz, 5) AS calinski_harabasz,
  {", ".join(f"round({c}, 5) AS {c}" for c in ("accuracy", "precision_macro", "recall_macro", "f1_macro", "f1_weighted", "ari", "nmi", "homogeneity", "completeness", "v_measure"))} FROM indices, supervised, agreement""",
        "test_metrics": f"""{coarse()}, {at(COARSE[0], 'test')}, got AS (SELECT s.*, coalesce(cluster_id, -1) AS cluster_id FROM scaled s LEFT JOIN best ON id = CustomerID WHERE split = 'test'), pts AS (SELECT * FROM got WHERE cluster_id >= 0), {_indices()}
SELECT (SELECT count(*) FROM got) AS n_points, (SELECT count(*) FROM got WHERE cluster_id = -1) AS n_noise, (SELECT count(DISTINCT cluster_id) FROM pts) AS n_clusters, round((SELECT avg(CASE WHEN cluster_id >= 0 THEN 1.0 ELSE 0.0 END) FROM got), 5) AS coverage,
  round(silhouette, 5) AS silhouette, round(davies_bouldin, 5) AS davies_bouldin FROM indices""",
        "grid_search": f"{searched} SELECT CAST(xi AS BIGINT) AS xi, tau, n_clusters, n_noise, coverage, silhouette, davies_bouldin, calinski_harabasz, round(quality_score, 5) AS quality_score FROM scores",
        "best_params": f"""{searched}, pool AS (SELECT * FROM scores WHERE quality_score > -1e8 OR (SELECT max(quality_score) FROM scores) <= -1e8),
tiers AS (SELECT *, CASE WHEN silhouette > 0 AND n_clusters BETWEEN 4 AND 10 AND coverage >= 0.85 THEN 0 WHEN silhouette > 0 THEN 1 ELSE 2 END AS tier FROM pool)
SELECT CAST(xi AS BIGINT) AS xi, tau FROM tiers ORDER BY tier, CASE WHEN tier < 2 THEN silhouette ELSE quality_score END DESC NULLS LAST, xi, tau LIMIT 1""",
        "best_per_algorithm": f"""SELECT algorithm, params, round(silhouette, 5) AS silhouette FROM (SELECT *, row_number() OVER (PARTITION BY algorithm ORDER BY silhouette DESC, params) AS k FROM (
{" UNION ALL ".join(of_dbscan(e) for e in (0.2, 0.3, 0.5))} UNION ALL SELECT 'grid', 'xi={COARSE[0]}, tau={COARSE[1]}', silhouette FROM ({coarse()}, {at(COARSE[0], 'train')}, got AS (SELECT CustomerID, coalesce(cluster_id, -1) AS cluster_id FROM train LEFT JOIN best ON id = CustomerID), {made('got')} SELECT silhouette FROM indices)) WHERE silhouette IS NOT NULL) WHERE k = 1""",
        "synthetic_smoke": f"{synthetic} SELECT p AS cluster_id, count(*) AS n FROM found GROUP BY 1",
        "synthetic_verify": f"""{synthetic}, tab AS (SELECT y, p, count(*) AS n FROM found GROUP BY 1, 2), {_VOTES}, {_SUPERVISED} SELECT {", ".join(f"round({c}, 6) AS {c}" for c in ("accuracy", "precision_macro", "recall_macro", "f1_macro", "f1_weighted"))} FROM supervised""",
        "contract_violations": f"""{ALL}, {SCALED} SELECT 'null_or_nan' AS "check", count(*) FILTER ({_each('@ IS NULL OR isnan(@)', by=' OR ')}) AS violations FROM profiles UNION ALL SELECT 'infinite', count(*) FILTER ({_each('isinf(@)', by=' OR ')}) FROM profiles
UNION ALL SELECT 'too_few_orders', count(*) FILTER (frequency < 2) FROM profiles UNION ALL SELECT 'scaled_null_or_nan', count(*) FILTER ({_each('@ IS NULL OR isnan(@)', by=' OR ')}) FROM scaled
UNION ALL SELECT 'outside_unit_range', count(*) FILTER ({_each('@ < -1e-6 OR @ > 1 + 1e-6', by=' OR ')}) FROM scaled""",
        "dbscan_core_points": f"{ALL}, {SCALED}, {_NEAR} SELECT a AS CustomerID, count(*) AS n_near FROM closeby GROUP BY 1 HAVING count(*) >= 4",
        "dbscan_labels": f"""{ALL}, {SCALED}, {_NEAR}, core AS (SELECT a AS id FROM closeby GROUP BY 1 HAVING count(*) >= 4), links AS (SELECT a, b FROM closeby WHERE a IN (SELECT id FROM core) AND b IN (SELECT id FROM core)),
least_(id, comp) AS (SELECT id, id FROM core UNION SELECT l.b, r.comp FROM least_ r JOIN links l ON l.a = r.id AND r.comp < l.b),
comp AS (SELECT id, min(comp) AS comp FROM least_ GROUP BY 1), roots AS (SELECT comp, row_number() OVER (ORDER BY comp) - 1 AS cluster FROM (SELECT DISTINCT comp FROM comp)),
own AS (SELECT id, cluster FROM comp JOIN roots USING (comp)), border AS (SELECT a AS id, min(cluster) AS cluster FROM closeby JOIN own ON own.id = b GROUP BY 1)
SELECT CustomerID, coalesce(o.cluster, b.cluster, -1) AS cluster_id FROM train LEFT JOIN own o ON o.id = CustomerID LEFT JOIN border b ON b.id = CustomerID""",
    }
    for k in (1, 2, 3):
        dims, cells = (" || ',' || ".join(f"{c}{i}" for i in range(1, k + 1)) for c in "dc")
        out[f"dense_units_{k}d"] = f"{fine()} SELECT CAST({dims} AS VARCHAR) AS dims, CAST({cells} AS VARCHAR) AS cells, cnt, round(cnt / n, 6) AS density FROM u{k}, np"
    for name in ("recency", "avg_basket", "product_diversity", "return_rate", "weekend_ratio", "repeat_category_rate"):
        out[name] = f"{ALL} SELECT CustomerID, round({name}, 6) AS {name} FROM profiles"
    out["frequency_monetary"] = f"{ALL} SELECT CustomerID, round(frequency, 6) AS frequency, round(monetary, 6) AS monetary FROM profiles"
    out["customer_profiles"] = f"{ALL} SELECT CustomerID, {_rounded(COLS)} FROM profiles"
    return out
