"""Names, labels and report texts as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def stem(path: Column) -> Column:
    """The file's name without its last extension; a leading dot starts no extension."""
    return F.regexp_replace(base_name(path), r"(?<=.)\.[^.]*$", "")


def out_stem(path: Column, root: Column) -> Column:
    """The stem, with the folders below ``root`` before it; without them at the root or outside of it."""
    inside = F.startswith(path, F.concat(root, F.lit("/")))
    folder = F.regexp_replace(F.substring(path, F.length(root) + 2, F.length(path)), r"/?[^/]*$", "")
    prefix = F.regexp_replace(F.replace(folder, F.lit("/"), F.lit("_")), "^_+|_+$", "")
    return F.when(inside & (folder != ""), F.concat(prefix, F.lit("_"), stem(path))).otherwise(stem(path))


def label_path(path: Column, image_root: Column, label_root: Column) -> Column:
    """Where the label of an image lies when label folders mirror image folders."""
    rest = F.substring(path, F.length(image_root) + 2, F.length(path))
    return F.concat(label_root, F.lit("/"), F.regexp_replace(rest, r"\.[^./]*$", ""), F.lit(".txt"))


def safe_name(text: Column) -> Column:
    """Letters, digits, - and _ stay, white space becomes one _, all else _; ``model`` if nothing is left."""
    kept = F.regexp_replace(F.trim(text), r"[^\p{L}\p{N}\-_ ]", "_")
    joined = F.regexp_replace(F.trim(kept), " +", "_")
    return F.when(joined == "", "model").otherwise(joined)


def hex_to_bgr(colour: Column) -> dict[str, Column]:
    c = F.regexp_replace(colour, "^#+", "")
    return {k: F.conv(F.substring(c, at, 2), 16, 10).cast("int") for k, at in (("b", 5), ("g", 3), ("r", 1))}


def human_size(n: Column) -> Column:
    """Bytes whole, then KB, MB and GB with one decimal (half to even)."""

    def step(k: int, unit: str) -> Column:
        return F.concat(F.format_string("%.1f", F.bround(n / float(1024**k), 1)), F.lit(f" {unit}"))

    return F.when(n < 1024, F.concat(n.cast("long").cast("string"), F.lit(" B"))).when(n < 1024**2, step(1, "KB")).when(n < 1024**3, step(2, "MB")).otherwise(step(3, "GB"))


def text_bar(n: Column, most: Column, width: int = 22) -> Column:
    return F.repeat(F.lit("█"), F.bround(width * n / F.greatest(F.lit(1), most), 0).cast("int"))


def group_key(mode: str, path: Column, root: Column, dup_group: Column, index: Column) -> Column:
    """What must stay together in a split: near-duplicates, folders, name prefixes or nothing."""
    # The prefixes of keys of single images and of groups of copies.
    alone = F.concat(F.lit("tek"), index.cast("string"))
    if mode == "dup":
        return F.when(dup_group.isNotNull(), F.concat(F.lit("dup"), dup_group.cast("string"))).otherwise(alone)
    if mode == "folder":
        folder = F.regexp_replace(F.substring(path, F.length(root) + 2, F.length(path)), r"/?[^/]*$", "")
        return F.when(folder == "", ".").otherwise(folder)
    if mode == "prefix":
        return F.substring_index(base_name(path), "_", 1)
    return alone


def status_mark(n_errors: Column, has_label: Column, dup_group: Column, dup_rep: Column, n_warns: Column) -> Column:
    """! errors, ○ no label, » a copy that isn't its group's first, ? warnings, ✓ fine: the first that holds."""
    return F.when(n_errors > 0, "!").when(~has_label, "○").when(dup_group.isNotNull() & ~dup_rep, "»").when(n_warns > 0, "?").otherwise("✓")


def class_summary(names: Column, most: int = 40) -> Column:
    """``N classes: a, b... (+k)``."""
    n = F.size(names)
    more = F.when(n > most, F.concat(F.lit("… (+"), (n - most).cast("string"), F.lit(")"))).otherwise("")
    return F.concat(n.cast("string"), F.lit(" classes: "), F.array_join(F.slice(names, 1, most), ", "), more)


def clip_name(prefix: Column, index: Column, ext: Column) -> Column:
    i = index.cast("string")
    return F.concat(prefix, F.lit("clip_"), F.when(F.length(i) < 3, F.lpad(i, 3, "0")).otherwise(i), ext)


def clip_index(name: Column) -> Column:
    """The number in a clip's name, or null."""
    found = F.regexp_extract(name, r"clip_(\d+)", 1)
    return F.when(found != "", found.cast("long"))


def numbered_name(name: Column, k: Column) -> Column:
    """The name; with __1, __2 and so on for its further rows, numbered by ``k`` from 0."""
    return F.when(k == 0, name).otherwise(F.concat(name, F.lit("__"), k.cast("string")))


def numbered_label(label: Column, k: Column) -> Column:
    """The label; with (2), (3) and so on for its further rows, numbered by ``k`` from 0."""
    return F.when(k == 0, label).otherwise(F.concat(label, F.lit(" ("), (k + 1).cast("string"), F.lit(")")))


def label_base(label: Column) -> Column:
    """The trimmed label, ``Model`` if empty."""
    return F.when(F.coalesce(F.trim(label), F.lit("")) == "", "Model").otherwise(F.trim(label))
