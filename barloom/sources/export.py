"""CSV export with a header and quoting of commas, quotes and line breaks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The columns of each export flavour.
FLAVOURS = {
    "equity": ["symbol", "ts", "equity", "ret"],
    "portfolio": [
        "ticker", "shares", "entry_price", "current_price", "cost_basis", "current_value",
        "unrealized_pnl", "unrealized_pnl_pct",
    ],
    "walk_forward": [
        "symbol", "win", "train_start", "train_end", "test_start", "test_end", "best_params",
        "train_sharpe", "test_sharpe", "test_return", "test_max_drawdown", "test_n_trades",
    ],
}


def csv(df: DataFrame, path: str, flavour: str | None = None) -> None:
    """One file per partition; maps and arrays are written as JSON."""
    if flavour is not None:
        df = df.select(*[c for c in FLAVOURS[flavour] if c in df.columns])
    nested = [f.name for f in df.schema if f.dataType.typeName() in ("array", "map", "struct")]
    df = df.withColumns({c: F.to_json(c) for c in nested})
    df.write.mode("errorifexists").option("header", True).option("escape", '"').option(
        "emptyValue", ""
    ).csv(path)
