"""Raw files by user, in any file system that Spark reaches: {root}/{user_id}/{file_id}_{filename}."""

from __future__ import annotations

from pyspark.sql import SparkSession


class BlobStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _at(self, key: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{key}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def save(self, user_id: str, file_id: str, filename: str, raw: bytes) -> str:
        """Writes the bytes and returns their key; names can't leave the user's folder."""
        if not user_id:
            raise ValueError("a file needs a user_id")
        key = "/".join(p.replace("/", "_").replace("\\", "_").lstrip(".") for p in (user_id, f"{file_id}_{filename}"))
        fs, path = self._at(key)
        out = fs.create(path, True)
        try:
            out.write(bytearray(raw))
        finally:
            out.close()
        return key

    def resolve(self, key: str) -> str | None:
        """The path of a key's file, for Spark to read; None if there is none."""
        fs, path = self._at(key)
        return path.toString() if fs.exists(path) else None

    def delete(self, key: str) -> bool:
        fs, path = self._at(key)
        return fs.exists(path) and fs.delete(path, False)
