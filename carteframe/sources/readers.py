"""Readers of catalog files and trees: CSV, JSON, JSON-LD in pages, spreadsheets."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators import writes

#: Header aliases, compared without case and punctuation.
ALIASES = {
    "name": ["name", "item", "itemname", "itemtitle", "title", "menuitem"],
    "description": ["description", "desc", "details", "detail", "itemdescription"],
    "category": ["category", "cat", "section", "group", "menusection", "menugroup"],
    "subcategory": ["subcategory", "subcat", "subsection"],
    "price": ["price", "cost", "amount", "baseprice", "listprice"],
    "price_cents": ["pricecents"],
    "size": ["size", "portion", "variant", "serving"],
    "sku": ["sku", "code", "plu", "itemcode"],
}


def csv_items(spark: SparkSession, path: str) -> DataFrame:
    """Rows of CSV files with a header; known headers under their field names, the rest in a map."""
    rows = spark.read.csv(path, header=True, encoding="UTF-8", multiLine=True, escape='"')
    for name in rows.columns:
        if name.startswith("﻿"):
            rows = rows.withColumnRenamed(name, name[1:])
    return writes.mapped(rows, writes.header_map(rows.columns, ALIASES))


def json_items(spark: SparkSession, path: str) -> DataFrame:
    """Items of JSON documents: an object with items, or a bare list of objects."""
    item = "struct<name:string,description:string,category:string,price:string,size:string,tags:array<string>>"
    text = spark.read.text(path, wholetext=True)
    either = F.coalesce(F.from_json("value", f"struct<items:array<{item}>>")["items"], F.from_json("value", f"array<{item}>"))
    return text.select(F.explode(either).alias("item")).select("item.*")


_MENU_ITEM = "struct<name:string,description:string,offers:struct<price:string>>"
_SECTION = f"struct<name:string,hasMenuItem:array<{_MENU_ITEM}>>"
JSONLD = f"struct<`@graph`:array<struct<hasMenu:struct<hasMenuSection:array<{_SECTION}>>>>,hasMenu:struct<hasMenuSection:array<{_SECTION}>>>"


def jsonld_items(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """id, section, name and price_cents of menu items in a page's linked data; prices are truncated to cents, free items left out."""
    blocks = F.regexp_extract_all(html_col, F.lit(r'(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>'), F.lit(1))
    tree = pages.select(id_col, F.explode(blocks).alias("_b")).select(id_col, F.from_json("_b", JSONLD).alias("t"))
    menus = F.concat(F.coalesce(F.transform("t.@graph", lambda g: g["hasMenu"]), F.array().cast(f"array<struct<hasMenuSection:array<{_SECTION}>>>")), F.array("t.hasMenu"))
    rows = tree.select(id_col, F.explode(menus).alias("m")).select(id_col, F.explode("m.hasMenuSection").alias("s")).select(id_col, F.col("s.name").alias("section"), F.explode("s.hasMenuItem").alias("i"))
    cents = F.floor(F.round(F.col("i.offers.price").try_cast("double") * 100, 6)).cast("bigint")
    return rows.select(id_col, "section", F.col("i.name").alias("name"), cents.alias("price_cents")).where("price_cents > 0 and name is not null")


def flattened(tree: DataFrame, id_col: str, categories: str) -> DataFrame:
    """categories[].items[].sizes[] to rows: one per size named Base (Size), one for an item without sizes."""
    items = tree.select(id_col, F.posexplode(categories).alias("_c", "c")).select(id_col, "_c", F.col("c.name").alias("category"), F.posexplode("c.items").alias("_i", "i"))
    none = F.array(F.struct(F.lit(None).cast("string").alias("name"), F.col("i.price_cents").alias("price_cents")))
    sized = items.select(id_col, "_c", "_i", "category", F.col("i.name").alias("base"), F.posexplode(F.when(F.size("i.sizes") > 0, F.transform("i.sizes", lambda s: F.struct(s["name"].alias("name"), s["price_cents"].alias("price_cents")))).otherwise(none)).alias("_s", "s"))
    return sized.select(id_col, "_c", "_i", "_s", "category", F.when(F.col("s.name").isNotNull(), F.concat("base", F.lit(" ("), F.col("s.name"), F.lit(")"))).otherwise(F.col("base")).alias("name"), "s.price_cents").toDF(id_col, "category_pos", "item_pos", "size_pos", "category", "name", "price_cents")


def pipe_table(text: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Lines category|name|price of a text to rows; lines without a readable price are left out."""
    from ..functions import prices

    parts = text.select(id_col, F.explode(F.split(text_col, "\n")).alias("line")).select(id_col, F.split("line", r"\s*\|\s*").alias("p")).where(F.size("p") >= 3)
    return parts.select(id_col, F.trim(F.col("p")[0]).alias("category"), F.trim(F.col("p")[1]).alias("name"), prices.strict_cents(F.trim(F.col("p")[2])).alias("price_cents")).where("price_cents is not null and name != ''")


class WorkbookSource(DataSource):
    """spark.read.format("workbook").schema(...).load(path): the first sheet of a spreadsheet file, one partition per file."""

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> str:
        return "row int, cells array<string>"

    def reader(self, schema) -> DataSourceReader:
        return _WorkbookReader(self.options["path"].split(","))


class _WorkbookReader(DataSourceReader):
    def __init__(self, paths: Sequence[str]) -> None:
        self.paths = paths

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in self.paths]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        import re
        import zipfile
        from xml.etree import ElementTree

        tag = lambda e: e.tag.rpartition("}")[2]
        with zipfile.ZipFile(partition.value) as book:
            shared = []
            if "xl/sharedStrings.xml" in book.namelist():
                shared = ["".join(t.text or "" for t in s.iter() if tag(t) == "t") for s in ElementTree.parse(book.open("xl/sharedStrings.xml")).getroot()]
            sheet = ElementTree.parse(book.open("xl/worksheets/sheet1.xml")).getroot()
            for row in (e for e in sheet.iter() if tag(e) == "row"):
                cells: list[str | None] = []
                for c in row:
                    column = 0
                    for ch in re.match(r"[A-Z]+", c.get("r", "A"))[0]:
                        column = column * 26 + ord(ch) - 64
                    cells += [None] * (column - len(cells))
                    value = next((v.text for v in c.iter() if tag(v) in ("v", "t")), None)
                    cells[column - 1] = shared[int(value)] if c.get("t") == "s" and value else value
                if any(x and x.strip() for x in cells):
                    yield int(row.get("r", 0)), cells
