"""Tables that the queries run on, as DataFrames and as the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_FILES = """
select doc_id as file_id, md5, n_chars as size, 1704067200.0 + doc_id*3600 as mtime, source,
       case when cast(substr(source,4) as int) % 2 = 0 then 'organized' else 'snapshot' end as folder,
       concat('/', case when cast(substr(source,4) as int) % 2 = 0 then 'organized' else 'snapshot' end,
              '/', source, '/', lang, '/doc-', substr(md5,1,8),
              case when rn = 1 then '.txt'
                   when rn % 2 = 0 then concat(' (', cast(rn as {text}), ').txt')
                   else '-at-2025-01-02T03_04_05.678Z-pinned.txt' end) as path
from (select *, row_number() over (partition by md5 order by doc_id) as rn
      from (select doc_id, md5(text) as md5, n_chars, source, lang from documents) h) t
"""
_LOCAL = """
select doc_id as file_id, md5(text) as md5, n_chars as size,
       concat(source,'/',lang,'/',
         case when doc_id % 10 = 1 then concat('doc-', cast(doc_id as {text}), '-at-2025-01-02T03_04_05.678Z.txt')
              when doc_id % 10 = 3 then concat('old name ', cast(doc_id as {text}), '.txt')
              when doc_id % 10 = 4 then concat('document number ', lpad(cast(doc_id as {text}),5,'0'), '.txt')
              else concat('doc-', cast(doc_id as {text}), '.txt') end) as rel
from documents where doc_id % 10 <> 9
"""
_REMOTE = """
select doc_id as id, md5(text) as md5, case when doc_id % 10 = 2 then n_chars + 1 else n_chars end as size,
       case when doc_id % 10 = 5 then 1 else 0 end as is_native,
       concat(case when doc_id % 10 = 3 then 'archive' else source end,'/',lang,'/',
         case when doc_id % 10 = 3 then concat('new-', cast(doc_id as {text}), '.txt')
              when doc_id % 10 = 4 then concat('document number ', lpad(cast(doc_id as {text}),5,'0'), ' with its full title.txt')
              else concat('doc-', cast(doc_id as {text}), '.txt') end) as rel
from documents where doc_id % 10 <> 0
"""


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of two trees with duplicates across and within them, made from documents."""
    return spark.sql(_FILES.format(text="string").replace("from documents)", "from {documents})"), documents=table(spark, sf_dir, "documents"))


def local_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_LOCAL.format(text="string").replace("from documents", "from {documents}"), documents=table(spark, sf_dir, "documents"))


def remote_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_REMOTE.format(text="string").replace("from documents", "from {documents}"), documents=table(spark, sf_dir, "documents"))


FILES_SQL = f"files as ({_FILES.format(text='varchar')})"
LOCAL_SQL = f"local_t as ({_LOCAL.format(text='varchar')})"
REMOTE_SQL = f"remote_t as ({_REMOTE.format(text='varchar')})"
#: Pieces of DuckDB SQL that several queries share.
BASE = "regexp_extract({p}, '[^/]*$')"
EXT = r"regexp_extract({n}, '(?s)^\.*[^.].*?(\.[^.]*)$', 1)"


def base(p: str = "path") -> str:
    return BASE.format(p=p)


def ext(n: str) -> str:
    return EXT.format(n=n)


def listed(values: list[str]) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"
