"""Namespaces: inode tables (inode, parent, name, kind, size, pos) with one row for each name in a directory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROOT = 1
DIRECTORY, FILE, SYMLINK, KIND = 0o040000, 0o100000, 0o120000, 0o170000
BLOCK, STAT_BLOCK = 4096, 512


def is_directory(mode: Column) -> Column:
    return mode.bitwiseAND(KIND) == DIRECTORY


def is_file(mode: Column) -> Column:
    return mode.bitwiseAND(KIND) == FILE


def is_symlink(mode: Column, compatible: bool = False) -> Column:
    """``compatible``: any bit of the link's kind will do, which also holds for regular files."""
    return mode.bitwiseAND(SYMLINK) != 0 if compatible else mode.bitwiseAND(KIND) == SYMLINK


def permissions(mode: Column) -> Column:
    return mode.bitwiseAND(0o777)


def create(inodes: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(inodes with the new ones, refused with ``reason``): the parent must be a directory and the name free."""
    parents = inodes.where("kind = 'directory'").select(F.col("inode").alias("parent"), F.lit(True).alias("_dir"))
    taken = inodes.select("parent", "name", F.lit(True).alias("_taken"))
    first = F.row_number().over(Window.partitionBy("parent", "name").orderBy("inode"))
    marked = new.withColumn("_nth", first).join(parents, "parent", "left").join(taken, ["parent", "name"], "left")
    reason = F.when(F.col("_dir").isNull(), "no directory").when(F.col("_taken").isNotNull() | (F.col("_nth") > 1), "exists")
    marked = marked.withColumn("reason", reason)
    return inodes.unionByName(marked.where("reason IS NULL").select(inodes.columns)), marked.where("reason IS NOT NULL").select(*new.columns, "reason")


def remove(inodes: DataFrame, gone: DataFrame, kind: str) -> DataFrame:
    """Unlinks files, or removes empty directories; ``gone``: (inode). Other kinds and full directories stay."""
    full = inodes.select(F.col("parent").alias("inode")).distinct()
    go = inodes.where(F.col("kind") == kind).join(gone.select("inode"), "inode", "left_semi").where(F.col("inode") != ROOT)
    return inodes.join(go.join(full, "inode", "left_anti").select("inode"), "inode", "left_anti")


def lookup(inodes: DataFrame, asked: DataFrame) -> DataFrame:
    """(parent, name, inode): null if there is no such name."""
    return asked.join(inodes.select("parent", "name", "inode"), ["parent", "name"], "left")


def stat(inodes: DataFrame) -> DataFrame:
    """(inode, kind, size, blocks, nlink, block_size): a directory's links are two and one for each child."""
    children = inodes.where(F.col("parent") != F.col("inode")).groupBy(F.col("parent").alias("inode")).agg(F.count("*").alias("children"))
    out = inodes.join(children, "inode", "left")
    nlink = F.when(F.col("kind") == "directory", 2 + F.coalesce("children", F.lit(0))).otherwise(1)
    return out.select("inode", "kind", "size", F.ceil(F.col("size") / STAT_BLOCK).cast("long").alias("blocks"), nlink.cast("long").alias("nlink"), F.lit(BLOCK).alias("block_size"))


def listing(inodes: DataFrame, offset: int = 0, most: int | None = None) -> DataFrame:
    """(parent, place, name, inode): ``.``, ``..`` and the children of every directory in order; ``offset`` and ``most`` page
    within each."""
    dirs = inodes.where("kind = 'directory'")
    dots = dirs.select(F.col("inode").alias("parent"), F.lit(0).alias("place"), F.lit(".").alias("name"), "inode").unionByName(dirs.select(F.col("inode").alias("parent"), F.lit(1).alias("place"), F.lit("..").alias("name"), F.col("parent").alias("inode")))
    place = (F.row_number().over(Window.partitionBy("parent").orderBy("pos", "inode")) + 1).cast("int")
    out = dots.unionByName(inodes.where(F.col("parent") != F.col("inode")).select("parent", place.alias("place"), "name", "inode"))
    out = out.where(F.col("place") >= offset)
    return out if most is None else out.where(F.col("place") < offset + most)


def paths(inodes: DataFrame) -> DataFrame:
    """(inode, path, level): one equi-join for each level of the tree, until no child is left. Inodes that no path from a
    root reaches have no row, so a cycle ends nothing."""
    level = inodes.where(F.col("inode") == F.col("parent")).select("inode", F.lit("").alias("path"), F.lit(0).alias("level"))
    out = level
    edges = inodes.where(F.col("inode") != F.col("parent")).select("inode", "parent", "name")
    while True:
        level = level.select(F.col("inode").alias("parent"), "path", "level").join(edges, "parent").select("inode", F.concat("path", F.lit("/"), "name").alias("path"), (F.col("level") + 1).alias("level"))
        if level.isEmpty():
            return out
        out = out.unionByName(level)


def new_inode(inode: Column, parent: Column, name: Column, kind: Column, moment: Column) -> Column:
    """The attributes a new inode starts with: files are 0644 with one link, directories 0755 with two."""
    d = kind == "directory"
    mode = F.when(d, DIRECTORY | 0o755).otherwise(FILE | 0o644)
    return F.struct(inode.alias("inode"), parent.alias("parent"), name.alias("name"), kind.alias("kind"), mode.alias("mode"), F.when(d, 2).otherwise(1).alias("nlink"), F.lit(0).cast("bigint").alias("size"), moment.alias("created_at"), moment.alias("modified_at"))


def handles(log: DataFrame) -> DataFrame:
    """(mount, handle, inode, read, write, opened, released) of a log (mount, seq, op, inode, handle, read, write): each open
    gets the mount's next number, from 1; ``released`` is the first release of that number after it, null while open."""
    opens = log.where("op = 'open'").withColumn("handle", F.row_number().over(Window.partitionBy("mount").orderBy("seq")).cast("bigint")).withColumnRenamed("seq", "opened")
    ends = log.where("op = 'release'").select("mount", "handle", F.col("seq").alias("_end"))
    out = opens.select("mount", "handle", "inode", "read", "write", "opened").join(ends, ["mount", "handle"], "left")
    after = F.when(F.col("_end") > F.col("opened"), F.col("_end"))
    return out.groupBy("mount", "handle", "inode", "read", "write", "opened").agg(F.min(after).alias("released"))


def written(inodes: DataFrame, writes: DataFrame) -> DataFrame:
    """Inodes after ``writes`` (inode, offset, bytes): a file ends where its farthest write ends, if that is beyond its
    end; writes to directories do nothing."""
    ends = writes.groupBy("inode").agg(F.max(F.col("offset") + F.col("bytes")).alias("_end"))
    size = F.when(F.col("kind") == "file", F.greatest("size", "_end")).otherwise(F.col("size"))
    return inodes.join(ends, "inode", "left").withColumn("size", size).select(inodes.columns)


def from_paths(df: DataFrame, path: Column, size: Column) -> DataFrame:
    """(dir, name, kind, size): every directory on the way to each path, and the paths as files."""
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    rows = df.select(parts.alias("p"), size.cast("long").alias("size")).where(F.size("p") > 0)
    rows = rows.select("p", "size", F.explode(F.sequence(F.lit(1), F.size("p"))).alias("n"))
    whole = F.concat(F.lit("/"), F.array_join(F.slice("p", F.lit(1), F.col("n") - 1), "/"))
    last = F.col("n") == F.size("p")
    rows = rows.select(whole.alias("dir"), F.get("p", F.col("n") - 1).alias("name"), F.when(last, "file").otherwise("directory").alias("kind"), F.when(last, F.col("size")).otherwise(0).alias("size"))
    return rows.groupBy("dir", "name").agg(F.min("kind").alias("kind"), F.max("size").alias("size"))
