"""SQL fragments shared by several oracles."""


def otsu(name: str, src: str, value: str, keys: str = "") -> str:
    """CTEs ending in ``name`` (keys, threshold) for the Otsu threshold of ``value`` in ``src``."""
    k = keys + "," if keys else ""
    join = f"USING ({keys})" if keys else "ON true"
    part = f"PARTITION BY {keys}" if keys else ""
    return f"""{name}_l AS (SELECT {k} min({value}) AS lo, max({value}) AS hi FROM {src} GROUP BY ALL),
{name}_g AS (SELECT {k} {value} AS v, lo, hi, least(CAST(floor(({value} - lo) / (hi - lo) * 256) AS INT), 255) AS g FROM {src} JOIN {name}_l {join} WHERE hi > lo),
{name}_b AS (SELECT {k} lo, hi, CASE WHEN v < lo + g * ((hi - lo) / 256) THEN g - 1 WHEN g < 255 AND v >= lo + (g + 1) * ((hi - lo) / 256) THEN g + 1 ELSE g END AS bin, count(*) AS n FROM {name}_g GROUP BY ALL),
{name}_c AS (SELECT *, ((lo + bin * ((hi - lo) / 256)) + CASE WHEN bin = 255 THEN hi ELSE lo + (bin + 1) * ((hi - lo) / 256) END) / 2 AS centre FROM {name}_b),
{name}_w AS (SELECT {k} bin, centre, CAST(sum(n) OVER ({part} ORDER BY bin) AS DOUBLE) AS cn, CAST(sum(n) OVER ({part}) AS DOUBLE) AS tn, sum(n * centre) OVER ({part} ORDER BY bin) AS cm, sum(n * centre) OVER ({part}) AS tm FROM {name}_c),
{name}_s AS (SELECT {k} centre, row_number() OVER ({part} ORDER BY CASE WHEN cn < tn THEN pow(tm / tn * (cn / tn) - cm / tn, 2) / ((cn / tn) * (1 - cn / tn)) ELSE 0 END DESC, bin) AS rn FROM {name}_w),
{name} AS (SELECT {k} CASE WHEN hi <= lo THEN hi ELSE centre END AS threshold FROM {name}_l LEFT JOIN (SELECT * FROM {name}_s WHERE rn = 1) {join})"""


def scale(value: str, low: str, high: str) -> str:
    """Robust scale of a raw value between two log quantiles."""
    return f"CASE WHEN {high} > {low} THEN least(greatest((ln(1 + greatest({value}, 0)) - {low}) / ({high} - {low}), 0), 1) ELSE 0 END"


def logq(value: str, q: float) -> str:
    return f"quantile_cont(ln(1 + greatest({value}, 0)), {q})"


def aligned(value: str, threshold: str) -> str:
    t = f"least(greatest({threshold}, 1e-6), 1 - 1e-6)"
    v = f"least(greatest({value}, 0), 1)"
    return f"CASE WHEN {v} <= {t} THEN 0.5 * {v} / {t} ELSE 0.5 + 0.5 * ({v} - {t}) / (1 - {t}) END"


def clip(value: str, low: float, high: float) -> str:
    return f"least(greatest({value}, {low}), {high})"


def uniform(seed: object, *parts: str) -> str:
    text = " || '|' || ".join([f"'{seed}'", *[f"CAST({p} AS VARCHAR)" for p in parts]])
    return f"(CAST(CAST('0x' || substr(md5({text}), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496)"


def avg_rank(value: str, part: str = "") -> str:
    p = f"PARTITION BY {part} " if part else ""
    q = f"PARTITION BY {part}, {value}" if part else f"PARTITION BY {value}"
    return f"(rank() OVER ({p}ORDER BY {value}) + (count(*) OVER ({q}) - 1) / 2.0)"
