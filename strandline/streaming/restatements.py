"""Late and restated returns from a stream, let into a store of vintages through the gate."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.config import DEFAULT, Config
from strandline.operators import gate
from strandline.sources import vintages


def gated_upsert(root: str, today: Callable[[], date], indexes: list[str], order: str = "seq", cfg: Config = DEFAULT) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: each batch (series_id, kind, date, r and an order of changes) becomes a vintage, or is kept aside.

    The batch's last change of each series and date takes the place of what the
    store holds. The next state is checked against the last vintage; if all
    checks pass, the months it touches are written as a vintage named by the
    batch, else the batch goes to `refused` with the checks that failed. A batch that
    was handled before (a stream replays its last one) changes nothing.
    """

    def take(batch: DataFrame, batch_id: int) -> None:
        spark, name = batch.sparkSession, f"batch-{batch_id:012d}"
        known = vintages.names(spark, root)
        if name in known or _handled(batch, f"{root}/refused/{name}") or batch.isEmpty():
            return
        last = known[-1] if known else None
        changes = vintages.last_of_each(batch, order).persist()
        try:
            months = [r[0] for r in changes.select(vintages.month_of()).distinct().collect()]  # a batch's months
            held = vintages.read(spark, root, last) if last else vintages.empty(spark)
            failed = gate.checks(held, vintages.upserted(held, changes), today(), indexes, cfg).where("not passed") if last else None
            if failed is None or failed.isEmpty():
                touched = vintages.read(spark, root, last, months=months) if last else held
                vintages.write(vintages.upserted(touched, changes), root, name, replacing=last)
            else:
                reasons = failed.agg(F.array_sort(F.collect_list("check_name")).alias("failed"))
                changes.crossJoin(reasons).write.mode("overwrite").parquet(f"{root}/refused/{name}")  # one row of reasons
        finally:
            changes.unpersist()

    return take


def _handled(batch: DataFrame, path: str) -> bool:
    from pyspark.errors import AnalysisException

    try:
        batch.sparkSession.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):  # the second: a write that stopped half-way
            return False
        raise
    return True
