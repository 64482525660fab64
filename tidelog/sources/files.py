"""Small files and listings through Spark's own file systems, whatever store they are in."""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Folder:
    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.path = spark._jvm, path.rstrip("/")
        fs = self._at("").getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
        self.local = fs.getScheme() == "file"
        self.fs = fs.getRawFileSystem() if self.local else fs

    def _at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def exists(self, name: str) -> bool:
        return self.fs.exists(self._at(name))

    def _status(self, name: str):
        try:
            return self.fs.listStatus(self._at(name))
        except Py4JJavaError as e:
            if "FileNotFoundException" in e.java_exception.getClass().getName():
                return []
            raise

    def names(self, name: str = "") -> list[str]:
        return sorted(x.getPath().getName() for x in self._status(name))

    def size(self, name: str) -> int:
        """Bytes of all files below a folder."""
        return self.fs.getContentSummary(self._at(name)).getLength()

    def read(self, name: str) -> dict:
        stream = self.fs.open(self._at(name))
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def create(self, name: str, value: dict) -> bool:
        """A new file, whole from the moment it can be seen; False if there is one by that name, which stays.

        Of several that create the same name one succeeds: the file is written beside its place, then renamed, which HDFS
        refuses where the name is taken; on a local disk, where renaming would replace, it is linked."""
        beside = self._at(f"{name}.{uuid.uuid4().hex}.new")
        stream = self.fs.create(beside, False)
        stream.write(json.dumps(value).encode())
        stream.close()
        if not self.local:
            if self.fs.rename(beside, self._at(name)):
                return True
            self.fs.delete(beside, False)
            return False
        files, path = self.jvm.java.nio.file.Files, lambda p: self.jvm.java.io.File(p.toUri().getPath()).toPath()
        try:
            files.createLink(path(self._at(name)), path(beside))
            return True
        except Py4JJavaError as e:
            if "FileAlreadyExists" in e.java_exception.getClass().getName():
                return False
            raise
        finally:
            self.fs.delete(beside, False)

    def delete(self, name: str) -> None:
        self.fs.delete(self._at(name), True)
