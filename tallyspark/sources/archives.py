"""ZIP archives as a write-only Spark Python Data Source (``df.write.format("ziparchive")``):
each task packs its partition's ``(name, content)`` rows into archives of some ``ARCHIVE_BYTES`` of content in the
target folder (a shared, mounted path on a cluster).  Reading is
``sources.files.explode_archives`` (``binaryFile`` + stdlib ``zipfile``)."""

from __future__ import annotations

import os
import uuid
import zipfile

from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage


ARCHIVE_BYTES = 32 << 20  # content after which a task begins its next archive


class ZipArchiveDataSource(DataSource):
    @classmethod
    def name(cls):
        return "ziparchive"

    def writer(self, schema, overwrite):
        return ZipWriter(self.options)


class ZipWriter(DataSourceWriter):
    def __init__(self, options):
        self.path = options["path"]

    def write(self, iterator):
        from pyspark import TaskContext
        os.makedirs(self.path, exist_ok=True)
        pid, done, z, held = TaskContext.get().partitionId(), [], None, 0
        for row in iterator:
            if z is None:
                done.append(os.path.join(self.path, f".archive-{pid:05d}-{uuid.uuid4().hex}.tmp"))
                z, held = zipfile.ZipFile(done[-1], "w", zipfile.ZIP_DEFLATED), 0
            data = row["content"]
            data = data.encode("utf-8") if isinstance(data, str) else bytes(data)
            z.writestr(row["name"], data)
            held += len(data)
            if held >= ARCHIVE_BYTES:
                z.close()
                z = None
        if z is not None:
            z.close()
        for tmp in done:  # all of them are whole
            os.replace(tmp, tmp.replace(".tmp", ".zip").replace("/.archive-", "/archive-"))
        return WriterCommitMessage()


def register(spark) -> None:
    spark.dataSource.register(ZipArchiveDataSource)
