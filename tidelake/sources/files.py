"""Files of any store that Hadoop's FileSystem reaches, from the driver."""

from __future__ import annotations

from posixpath import normpath

from pyspark.sql import SparkSession


class Store:
    """Listing, renaming and small text files below one root folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.root = root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        path = self._jvm.org.apache.hadoop.fs.Path(self.root)
        self._gateway, self._conf = spark.sparkContext._gateway, spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = path.getFileSystem(self._conf)

    def at(self, *parts: str) -> str:
        """VAL-8: a path that stays below the root."""
        joined = "/".join(parts)
        if normpath("/" + joined) != "/" + joined.strip("/") or ".." in joined.split("/"):
            raise ValueError(f"{joined} leaves the data folder")
        return f"{self.root}/{joined.strip('/')}" if joined else self.root

    def _path(self, *parts: str):
        return self._jvm.org.apache.hadoop.fs.Path(self.at(*parts))

    def exists(self, *parts: str) -> bool:
        return self._fs.exists(self._path(*parts))

    def names(self, *parts: str) -> list[str]:
        """Names in a folder, sorted; none if it is missing."""
        return [n for n, _ in self.entries(*parts)]

    def entries(self, *parts: str) -> list[tuple[str, int]]:
        """(name, time of modification in ms), sorted."""
        if not self.exists(*parts):
            return []
        return sorted((s.getPath().getName(), s.getModificationTime()) for s in self._fs.listStatus(self._path(*parts)))

    def delete(self, *parts: str) -> bool:
        return self._fs.delete(self._path(*parts), True)

    def rename(self, source: str, target: str) -> None:
        """SNK-8's last step: the new name appears at once. An existing file is replaced in one step where the file system can do
        that (``FileContext``); an existing folder, or a file of one that can't, is first moved aside and put back if the new one
        can't take its place, so that its rows are never only in memory."""
        destination, origin = self._path(target), self._path(source)
        self._fs.mkdirs(destination.getParent())
        if not self._fs.exists(destination):
            if not self._fs.rename(origin, destination):
                raise OSError(f"could not rename {source} to {target}")
            return
        if not self._fs.getFileStatus(destination).isDirectory() and not self._fs.getFileStatus(origin).isDirectory():
            try:
                self._replace(origin, destination)
                return
            except Exception as reason:  # py4j wraps whatever the file system says
                if "UnsupportedFileSystem" not in str(reason) and "not supported" not in str(reason):
                    raise OSError(f"could not rename {source} to {target}") from reason
        aside = destination.suffix(".old.tmp")
        self._fs.delete(aside, True)
        if not self._fs.rename(destination, aside):
            raise OSError(f"could not move {target} aside")
        if not self._fs.rename(origin, destination):
            self._fs.rename(aside, destination)
            raise OSError(f"could not rename {source} to {target}")
        self._fs.delete(aside, True)

    def _replace(self, origin, destination) -> None:
        rename = self._jvm.org.apache.hadoop.fs.Options.Rename
        options = self._gateway.new_array(rename, 1)
        options[0] = rename.OVERWRITE
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf)
        context.rename(origin, destination, options)

    def write_text(self, text: str, *parts: str) -> None:
        """Written aside, then renamed."""
        aside = "/".join(parts) + ".tmp"
        out = self._fs.create(self._path(aside), True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        self.rename(aside, "/".join(parts))

    def read_text(self, *parts: str) -> str | None:
        if not self.exists(*parts):
            return None
        stream = self._fs.open(self._path(*parts))
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode(errors="replace")
        finally:
            stream.close()
