"""Quota verdicts in a stream: every request is numbered within its tenant's minute and day as it arrives.

The state of a tenant is two values: the counts of its newest minutes and of its newest days. Like the counters of a
service they expire some time after their last write, by the clock: the minutes after MINUTE_TTL, the days after DAY_TTL;
what is that much older than the tenant's newest request is left out of them. Requests of one micro-batch are numbered
by time and id; a request that arrives in a later batch is numbered after those before it.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from vitrine.config import DEFAULTS, UsageConfig
from vitrine.operators.usage import over_limit

#: Milliseconds.
MINUTE_TTL, DAY_TTL = 120_000, 2 * 24 * 3600 * 1000
#: The state store that keeps several states of a key. State that expires by the clock asks for one batch after the
#: other, so that a run over what is available would never end: batches without data are left out.
SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


class Numbering(StatefulProcessor):
    """Numbers the requests of one tenant in a micro-batch after those before."""

    def __init__(self, minute_ttl: int, day_ttl: int):
        self.ttl = {"minute": minute_ttl, "day": day_ttl}

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.counts = {unit: handle.getValueState(unit, "counts string", ttlDurationMs=ttl) for unit, ttl in self.ttl.items()}

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["ts", "request_id"], kind="stable")
        out = {"request_id": batch["request_id"], "tenant_id": batch["tenant_id"]}
        for unit, state in self.counts.items():
            value = state.get()
            before = {int(at): n for at, n in json.loads(value[0]).items()} if value else {}
            out[f"{unit}_count"] = batch.groupby(unit).cumcount() + 1 + batch[unit].map(before).fillna(0).astype("int64")
            for at, n in batch.groupby(unit).size().items():
                before[int(at)] = before.get(int(at), 0) + int(n)
            oldest = max(before) - self.ttl[unit] // 1000
            state.update((json.dumps({at: n for at, n in before.items() if at >= oldest}),))
        yield pd.DataFrame(out)

    def close(self) -> None:
        pass


def quota_hits(requests: DataFrame, cfg: UsageConfig = DEFAULTS.usage, *, minute_ttl: int = MINUTE_TTL,
               day_ttl: int = DAY_TTL) -> DataFrame:
    """The stream of (request_id, tenant_id, minute_count, daily_count, verdict) of a stream of requests with ``ts``.

    The session must have SETTINGS when the stream starts.
    """
    kinds = {f.name: f.dataType.simpleString() for f in requests.schema}
    keyed = requests.select("request_id", "tenant_id", "ts", *(
        F.unix_timestamp(F.date_trunc(unit, "ts")).alias(unit) for unit in ("minute", "day")))
    numbered = keyed.groupBy("tenant_id").transformWithStateInPandas(
        Numbering(minute_ttl, day_ttl), f"request_id {kinds['request_id']}, tenant_id {kinds['tenant_id']}, "
                                        "minute_count bigint, day_count bigint", "append", "processingTime")
    return numbered.withColumnRenamed("day_count", "daily_count").withColumn("verdict", over_limit(cfg))


def run(requests: DataFrame, path: str, cfg: UsageConfig = DEFAULTS.usage, **ttl: int) -> DataFrame:
    """Gives verdicts to everything available into files below ``path``, whose checkpoint keeps the state."""
    spark = requests.sparkSession
    own = {key: spark.conf.get(key) for key in SETTINGS}
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    try:
        stream = quota_hits(requests, cfg, **ttl)
        (stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{path}/checkpoint")
         .trigger(availableNow=True).start(f"{path}/out").awaitTermination())
    finally:
        for key, value in own.items():
            spark.conf.set(key, value)
    return spark.read.schema(stream.schema).parquet(f"{path}/out")
