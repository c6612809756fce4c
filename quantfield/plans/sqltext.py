"""Pieces of DuckDB SQL that the oracles share."""

EVENTS = "(SELECT user_id AS key, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i0, value AS x FROM events)"
PRICES = "(SELECT l_suppkey AS key, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_shipdate) - 1 AS i0, l_extendedprice AS x FROM lineitem)"


def grid(edges: tuple[int, ...] = (64,)) -> str:
    cols, rest, size = [], "p", 64
    for k, edge in enumerate(edges):
        size //= edge
        cols.append(f"({rest}) // {size} AS i{k + 1}")
        rest = f"({rest}) % {size}"
    return f"(SELECT vec_id // 128 AS slab, vec_id AS i0, {', '.join(cols)}, x FROM (SELECT vec_id, unnest(range(64)) AS p, unnest(embedding)::DOUBLE AS x FROM embeddings))"


def lattice(src: str, eb: float) -> str:
    return f"(SELECT *, floor(x / {2 * eb!r}e0 + 0.5e0)::BIGINT AS q FROM {src})"


def lorenzo(src: str, group: list[str], dims: list[str], order: int = 1) -> str:
    out = f"(SELECT *, q AS code FROM {src})"
    for dim in dims:
        w = f"(PARTITION BY {', '.join([*group, *[c for c in dims if c != dim]])} ORDER BY {dim})"
        lag = lambda k: f"coalesce(lag(code, {k}) OVER {w}, 0)"  # noqa: E731, B023
        e = f"code - {lag(1)}" if order == 1 else f"code - 2 * {lag(1)} + {lag(2)}"
        out = f"(SELECT * REPLACE (({e})::BIGINT AS code) FROM {out})"
    return out


def undo(src: str, group: list[str], dims: list[str], order: int = 1) -> str:
    out = f"(SELECT *, code AS back FROM {src})"
    for dim in dims:
        w = f"(PARTITION BY {', '.join([*group, *[c for c in dims if c != dim]])} ORDER BY {dim} ROWS UNBOUNDED PRECEDING)"
        for _ in range(order):
            out = f"(SELECT * REPLACE ((sum(back) OVER {w})::BIGINT AS back) FROM {out})"
    return out


def code(pred: str, eb: float | str, radius: int, slack: float = 1.0) -> str:
    """The quantizer with its rule half away from zero, as radius + k or 0. eb: a number or a column."""
    e = eb if isinstance(eb, str) else f"{eb!r}e0"
    r = f"(floor(abs(x - {pred}) / {e})::BIGINT + 1)"
    k = f"({r} // 2) * CASE WHEN x - {pred} < 0 THEN -1 ELSE 1 END"
    return f"CASE WHEN abs(x - {pred}) < {2.0 * radius!r}e0 * {e} AND {r} < {2 * radius} AND abs({pred} + 2e0 * {e} * ({k}) - x) <= {slack!r}e0 * {e} THEN {k} + {radius} ELSE 0 END::BIGINT"
