"""Steps over a catalog of files (folder, path, bias, width, height): listing, series of brackets, singles, named neutrals.

Files of a folder follow each other by name; every file of bias zero begins a new run.  Files of one run and size are a series
where there are two of them and two biases; the rest are singles.
"""

from __future__ import annotations

#: Endings of image files, in any case.
ENDINGS = (".jpg", ".jpeg", ".png")


def listed(source: str = "catalog", endings: tuple[str, ...] = ENDINGS) -> list[tuple[str, str]]:
    return [("listed", f"SELECT folder, path, bias, width, height FROM {source} WHERE {' OR '.join(f"lower(path) LIKE '%{e}'" for e in endings)}")]


def series(source: str = "catalog") -> list[tuple[str, str]]:
    """``groups`` (the series), ``members`` and ``singles``; files without a bias are singles."""
    zeros = "sum(CASE WHEN abs(bias) < 1.0e-6 THEN 1 ELSE 0 END) OVER (PARTITION BY folder ORDER BY path ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    same = "d.folder = g.folder AND d.k = g.k AND d.width = g.width AND d.height = g.height"
    return [
        *listed(source),
        ("keyed", f"SELECT folder, path, bias, width, height, {zeros} AS k FROM listed WHERE bias IS NOT NULL"),
        ("groups", "SELECT folder, k, width, height, count(*) AS members, count(DISTINCT bias) AS biases, min(path) AS first_path FROM keyed GROUP BY folder, k, width, height HAVING count(*) >= 2 AND count(DISTINCT bias) >= 2"),
        ("members", f"SELECT d.folder, d.path, first_path FROM keyed d JOIN groups g ON {same}"),
        ("singles", "SELECT c.folder, c.path, c.bias, c.width, c.height FROM listed c LEFT JOIN members m ON c.folder = m.folder AND c.path = m.path WHERE m.path IS NULL"),
    ]


def named() -> list[tuple[str, str]]:
    """``merged_named``: a single of bias zero joins the first series of its folder, name and size whose files are all called
    like it with ``_over`` or ``_under`` behind; each single joins one series."""
    stem = "lower(regexp_replace(path, '[.][^.]*$', ''))"
    return [
        ("stems", f"SELECT folder, path, first_path, regexp_extract({stem}, '^(.+)_(over|under)$', 1) AS base FROM members"),
        ("bases", "SELECT folder, first_path, min(base) AS base FROM stems GROUP BY folder, first_path HAVING min(base) = max(base) AND min(base) <> ''"),
        ("named_series", "SELECT b.folder, b.first_path, b.base, g.width, g.height FROM bases b JOIN groups g ON b.folder = g.folder AND b.first_path = g.first_path"),
        ("neutral", f"SELECT folder, path, width, height, {stem} AS base FROM singles WHERE abs(bias) <= 0.001e0"),
        ("matches", "SELECT n.folder, first_path, n.path, row_number() OVER (PARTITION BY n.folder, n.path ORDER BY first_path) AS rk FROM neutral n JOIN named_series s ON n.folder = s.folder AND n.base = s.base AND n.width = s.width AND n.height = s.height"),
        ("merged_named", "SELECT folder, first_path, path FROM matches WHERE rk = 1"),
    ]
