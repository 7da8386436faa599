"""Class names and dataset descriptions: small text files, read through Spark so that any store works."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from itertools import product
from posixpath import basename, dirname, join, normpath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Folders of images and of labels below a dataset's root, in order of preference.
IMAGE_FOLDERS = ("images", "image", "img", "fotolar")
LABEL_FOLDERS = ("labels", "label", "etiketler")
# Fixed value: the file of class names with colours.
CLASS_FILE = "labelapp_classes.json"
#: A description or list of names is small; a larger file is an error, not an absent one.
MOST_BYTES = 64 << 20


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists in whichever store it belongs to."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at))


def small_text(spark: SparkSession, path: str) -> str | None:
    """A small file's text, or None if it isn't there or is empty.

    It comes from the store itself: Spark's readers pass over names with a leading underscore or dot.
    """
    if not path_exists(spark, path):
        return None
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = at.getFileSystem(spark._jsc.hadoopConfiguration())
    size = store.getFileStatus(at).getLen()
    if size > MOST_BYTES:
        raise ValueError(f"{path} has {size} bytes; a description has {MOST_BYTES} at most")
    stream = store.open(at)
    try:
        content = bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
    finally:
        stream.close()
    return content.decode("utf-8", "replace") if content else None


class _Lines:
    """The lines of a description with their indents, read once from top to bottom."""

    def __init__(self, text: str):
        lines = (x.expandtabs() for x in text.splitlines())
        self.rows = [(len(x) - len(x.lstrip()), x.strip()) for x in lines if x.strip() and not x.lstrip().startswith("#")]
        self.at = 0

    def indent(self) -> int:
        return self.rows[self.at][0] if self.at < len(self.rows) else -1

    def value(self, indent: int) -> object:
        """The list or mapping whose entries stand at ``indent``; deeper lines that belong to none are passed over."""
        items: list = []
        pairs: dict = {}
        while self.indent() >= indent:
            depth, row = self.rows[self.at]
            if depth == indent and bool(items) and not row.startswith("-"):
                break
            self.at += 1
            if depth > indent:
                continue
            if row.startswith("-"):
                items.append(_scalar(row[1:]))
                continue
            key, _, rest = row.partition(":")
            below = self.indent() > indent or self.indent() == indent and self.rows[self.at][1].startswith("-")
            pairs[_scalar(key)] = _scalar(rest) if rest.strip() else self.value(self.indent()) if below else None
        return items or pairs


def _scalar(text: str) -> object:
    """A flow list, or a word without its quotes; None where nothing stands."""
    text = text.strip()
    if text.startswith("[") and text.endswith("]"):
        return [_scalar(x) for x in text[1:-1].split(",")]
    return text.strip("'\"") or None


def read_description(text: str) -> dict:
    """The part of YAML that dataset descriptions use: nested mappings, lists of words, flow lists."""
    found = _Lines(text).value(0)
    return found if isinstance(found, dict) else {}


def parse_names(text: str) -> dict[int, str]:
    """Class names of a dataset description, listed or by number."""
    names = read_description(text).get("names")
    numbered = names.items() if isinstance(names, dict) else enumerate(names if isinstance(names, list) else [])
    return {int(k): v for k, v in numbered if v and str(k).isdigit()}


def listed_names(text: str) -> dict[int, str]:
    """Class names of a text with a name in each line."""
    return dict(enumerate(filter(None, map(str.strip, text.splitlines()))))


#: Files that name classes, with their readers; a folder's own come before its parent's.
NAME_FILES = (("data.yaml", parse_names), ("data.yml", parse_names), ("classes.txt", listed_names), ("obj.names", listed_names), ("_darknet.labels", listed_names))


def load_names(spark: SparkSession, *folders: str) -> dict[int, str]:
    """Class names by the first file of NAME_FILES that names any, in ``folders`` or their parents."""
    places = (at for folder in folders for at in (folder.rstrip("/"), dirname(folder.rstrip("/"))))
    read = (parse(small_text(spark, join(at, file)) or "") for at, (file, parse) in product(places, NAME_FILES))
    return next(filter(None, read), {})


def names_table(spark: SparkSession, names: dict[int, str], source: str = "") -> DataFrame:
    """source, cls, name."""
    return spark.createDataFrame([(source, int(k), v) for k, v in names.items()], "source string, cls int, name string")


def load_coloured(spark: SparkSession, *places: str) -> list[tuple[str, tuple[int, int, int]]]:
    """(name, (red, green, blue)) of the classes in the first of ``places`` (files, or folders with a CLASS_FILE) that exists."""
    files = (p if p.endswith(".json") else join(p, CLASS_FILE) for p in places)
    there = next((p for p in files if path_exists(spark, p)), None)
    return [(x["name"], tuple(map(int, x["color"]))) for x in json.loads(small_text(spark, there) or "[]")] if there else []


def coloured_json(classes: Sequence[tuple[str, Sequence[int]]]) -> str:
    """The text of a CLASS_FILE."""
    return json.dumps([{"name": name, "color": list(colour)} for name, colour in classes], ensure_ascii=False, indent=2)


def dataset_folders(spark: SparkSession, root: str) -> tuple[str, str]:
    """The folders of images and of labels below ``root``: the first that exists of each kind, else ``root`` itself."""
    return tuple(next((p for n in names if path_exists(spark, p := join(root, n))), root) for names in (IMAGE_FOLDERS, LABEL_FOLDERS))


def label_folder(spark: SparkSession, images: str) -> str:
    """Where the labels of a folder of images are: labels beside a folder called images, labels within it, or the folder itself."""
    images = images.rstrip("/")
    beside = [join(dirname(images), "labels")] if basename(images).lower() == "images" else []
    return next((p for p in [*beside, join(images, "labels")] if path_exists(spark, p)), images)


def find_description(spark: SparkSession, root: str) -> str | None:
    """The data.yaml (or data.yml) of ``root`` or the first folder below it that has one; hidden folders are left out."""
    from .files import hidden_folder, list_files

    found = list_files(spark, root, ("yaml", "yml")).where((F.col("stem") == "data") & ~hidden_folder(F.col("rel_dir"), ()))
    first = found.orderBy(F.split("rel_dir", "/"), "ext").select("path").first()
    return first.path if first else None


def resolve_split(spark: SparkSession, value: object, root: str) -> DataFrame:
    """path: a description's train, val or test entry: nothing, a folder, a text file of paths, or a list of these."""
    from .files import list_images

    if value is None:
        return spark.createDataFrame([], "path string")
    if isinstance(value, (list, tuple)):
        parts = [resolve_split(spark, v, root) for v in value] or [resolve_split(spark, None, root)]
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out
    path = str(value) if str(value).startswith("/") or ":" in str(value) else f"{root.rstrip('/')}/{value}"
    if path.endswith(".txt"):
        return spark.read.text(path).select(F.trim("value").alias("path")).where("path <> ''")
    return list_images(spark, path).select("path")


def repaired_parts(parts: dict[str, str | None], folder: str, exists: Callable[[str], bool]) -> dict[str, str]:
    """train, val and test of a description with paths that exist.

    An absolute path counts as it stands, another from the description's folder. Exported descriptions often lead out of
    their folder to parts that lie within it, so a path that begins by going up is also looked for without that. Parts that
    lead nowhere are those of train.
    """
    places: dict[str, list[str]] = {}
    for name in ("train", "val", "test"):
        entry = (parts.get(name) or "").strip()
        steps = [s for s in entry.split("/") if s not in ("", ".")]
        ups = next((k for k, s in enumerate(steps) if s != ".."), len(steps))
        if entry.startswith("/"):
            places[name] = [normpath(entry)]
        elif steps:
            places[name] = [normpath("/".join([folder, *steps])), "/".join([folder.rstrip("/"), *steps[ups:]])]
    there = {p: exists(p) for p in sorted({p for of in places.values() for p in of})}
    found = {name: [p for p in of if there[p]] for name, of in places.items()}
    train = found.get("train", [])
    chosen = {name: found.get(name) or train for name in ("train", "val", "test")}
    return {name: of[0] for name, of in chosen.items() if of}
