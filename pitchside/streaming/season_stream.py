"""Incremental season arrival with Structured Streaming.

New season files dropped into a folder (or its subfolders) are picked up by the file source;
``foreachBatch`` loads each micro-batch into the stored star as one new version
(``plans.ingest.ingest``): the ledger of arrived files tells which of them are new, changed or
known, a file with the wrong header goes to quarantine with its reason while the others of its
batch load, and names that exist keep their ids.

A batch that dies before its version is published has changed nothing, and is loaded again; one that
dies after it finds its files in the ledger, unchanged, and has nothing to do.

State lives in the tables and the stream's checkpoint (kept under the star's
root unless given), not in a stateful operator: the reference itself loads one
season file after another.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..plans.ingest import LoadSpec, ingest
from ..session import qualified
from ..sources.season_csv import reader_options, with_source


def ingest_stream(spark: SparkSession, in_dir: str, out_root: str, checkpoint_location: str | None = None,
                  available_now: bool = True, max_files_per_trigger: int | None = None,
                  spec: LoadSpec = LoadSpec()) -> StreamingQuery:
    """Start the incremental load of one league's season files from ``in_dir`` into the star at ``out_root``.

    With ``available_now`` the query processes every file present and stops
    (a scheduled incremental load); otherwise it keeps watching the folder.
    Streams of several leagues into one star take turns: two that publish at
    once do not lose anything, the later one fails and goes on at its restart.
    """
    location = checkpoint_location or os.path.join(out_root, "_stream", spec.league_code)
    folder = qualified(spark, in_dir)
    reader = reader_options(spark.readStream)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)

    def load(batch: DataFrame, epoch: int) -> None:
        if not batch.isEmpty():
            ingest(batch, out_root, spec, folder=folder)

    writer = with_source(reader.csv(in_dir)).writeStream.foreachBatch(load).option("checkpointLocation", location)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()
