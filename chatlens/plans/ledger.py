"""Message ids for several writers: ranges reserved in a ledger of numbered entries.

An entry says which id is next and what each writer claimed last. A reservation writes the next entry under a name
of its own and renames it into place, which fails if another writer was faster; then the newer entry is read and the
reservation tried again (on object stores the rename has to be atomic for that). A claim is a writer's name and
batch number: a batch that is replayed gets the range it had, so ids are dense but for batches that failed for good.
"""

import json
import re
import uuid

from py4j.protocol import Py4JJavaError

from chatlens.session import remove

_ENTRY = re.compile(r"entry-(\d+)$")
_KEPT = 100  # older entries are removed; the latest holds all that is needed


class _Folder:
    def __init__(self, spark, root):
        self.spark, self.root = spark, root
        self.hadoop = spark._jvm.org.apache.hadoop.fs
        path = self.hadoop.Path(root)
        self.files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        self.context = self.hadoop.FileContext.getFileContext(self.files.getUri(), spark._jsc.hadoopConfiguration())
        self.files.mkdirs(path)

    def numbers(self):
        names = [status.getPath().getName() for status in self.files.listStatus(self.hadoop.Path(self.root))]
        return sorted(int(m.group(1)) for name in names if (m := _ENTRY.match(name)))

    def path(self, number):
        return self.hadoop.Path(self.root, f"entry-{number:012d}")

    def read(self, number):
        stream = self.files.open(self.path(number))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(text)

    def write(self, number, entry):
        """Whether the entry is in place now; False if another writer took its number."""
        draft = self.hadoop.Path(self.root, f".draft-{uuid.uuid4().hex}")
        stream = self.files.create(draft)
        try:
            stream.write(bytearray(json.dumps(entry).encode()))
        finally:
            stream.close()
        try:
            none = self.spark.sparkContext._gateway.new_array(self.hadoop.Options.Rename, 0)
            self.context.rename(draft, self.path(number), none)
        except Py4JJavaError:
            self.files.delete(draft, False)
            if not self.files.exists(self.path(number)):
                raise
            return False
        return True


def _latest(folder):
    """The latest entry and its number. An entry is removed only when 100 newer ones exist."""
    numbers = folder.numbers()
    if not numbers:
        return {"next": 1, "claims": {}}, 0
    return folder.read(numbers[-1]), numbers[-1]


def next_id(spark, root):
    """The first id that nobody has reserved."""
    return _latest(_Folder(spark, root))[0]["next"]


def reserve_ids(spark, root, writer, batch, n, at_least=1):
    """First id of a range of n, none below `at_least`. The same claim (writer and batch) gets the same range again."""
    folder = _Folder(spark, root)
    while True:
        entry, number = _latest(folder)
        known = entry["claims"].get(writer)
        if known and known["batch"] == batch and known["count"] >= n:
            return known["first"]
        if known and known["batch"] > batch:
            raise ValueError(f"batch {batch} of {writer} comes after its batch {known['batch']}")
        first = max(entry["next"], at_least)
        claim = {"batch": batch, "first": first, "count": n}
        if folder.write(number + 1, {"next": first + n, "claims": entry["claims"] | {writer: claim}}):
            for old in folder.numbers():
                if old <= number - _KEPT:
                    remove(spark, folder.path(old).toString())
            return first
