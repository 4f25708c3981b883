"""Registered corpus / structure queries over ``pages`` and ``documents``
(A3, A4, A6, B1, B2, B7, I1, I2, I15, K2, L38).  The oracles recompute the
same path and text operations in DuckDB."""

from __future__ import annotations

from pyspark.sql import functions as F

from codelake.functions import constants as K
from codelake.operators import classify as CL
from codelake.operators.lines import src_lines
from codelake.plans.catalog import files_of, register
from codelake.sources import fixtures as X
from codelake.sources.corpus import file_metadata

_LANG_CASE = ("case " + " ".join(f"when ext = '{e}' then '{lang}'" for e, lang in K.EXTENSION_LANGUAGE.items())
              + f" else '{K.UNKNOWN_LANGUAGE}' end")
_IGN = ", ".join(f"'{n}'" for n in K.IGNORE_NAMES)

# classified, non-ignored files of a corpus, in DuckDB
FILES_SQL = """
{cte}, raw as ({union}),
named as (select repo, path, regexp_replace(content, '\\r\\n?', chr(10), 'g') as content,
                 regexp_extract(path, '[^/]*$', 0) as name, string_split(path, '/') as parts from raw),
ext as (select *, lower(regexp_extract(name, '^.+(\\.[^.]*)$', 1)) as ext from named),
files as (select repo, path, name, ext, content, strlen(content) as size_bytes, {lang} as language, parts from ext
          where not list_has_any(parts, [{ign}])
            and len(list_filter(parts, lambda x: starts_with(x, '.'))) = 0)
"""


def files_sql(*corpora):
    return FILES_SQL.format(cte=X.cte(*corpora).strip(), union=X.union_sql(*corpora), lang=_LANG_CASE,
                            ign=_IGN)


WEB = ("pages_tree", "documents_tree")


@register("file_language", files_sql(*WEB) + "select repo, path, name, ext, language from files")
def q_file_language(spark, sf):
    return files_of(spark, sf, *WEB).select("repo", "path", "name", "ext", "language")


@register("file_metadata", files_sql("pages_tree") + """
select repo, path, language, 'utf-8' as encoding, cast(size_bytes as bigint) as size_bytes,
       cast(null as varchar) as last_modified from files
""")
def q_file_metadata(spark, sf):
    return file_metadata(files_of(spark, sf, "pages_tree"))


@register("project_totals", files_sql(*WEB) + """
select repo, count(*) as total_files, cast(coalesce(sum(size_bytes), 0) as bigint) as total_size
from files group by repo
""")
def q_project_totals(spark, sf):
    return CL.project_totals(files_of(spark, sf, *WEB))


@register("language_counts", files_sql(*WEB) + """
select repo, language, count(*) as n_files from files group by repo, language
""")
def q_language_counts(spark, sf):
    return CL.language_counts(files_of(spark, sf, *WEB))


@register("total_lines", files_sql("documents_tree") + """
select repo, cast(sum(case when content is null or content = '' then 0
                           when ends_with(content, chr(10)) then len(string_split(content, chr(10))) - 1
                           else len(string_split(content, chr(10))) end) as bigint) as total_lines
from files group by repo
""")
def q_total_lines(spark, sf):
    return CL.total_lines(files_of(spark, sf, "documents_tree"))


@register("entry_points", files_sql(*WEB) + """
select repo, path from files where lower(name) in ({names})
""".format(names=", ".join(f"'{n}'" for n in K.ENTRY_POINT_NAMES)))
def q_entry_points(spark, sf):
    return CL.entry_points(files_of(spark, sf, *WEB))


@register("analysable_files", files_sql(*WEB, "corpus_js", "corpus_cs") + """
select repo, path, language from files where language in ({langs})
""".format(langs=", ".join(f"'{n}'" for n in K.ANALYSABLE_LANGUAGES)))
def q_analysable_files(spark, sf):
    return CL.analysable(files_of(spark, sf, *WEB, "corpus_js", "corpus_cs")).select("repo", "path", "language")


@register("binary_files", files_sql(*WEB) + "select repo, path from files where false")
def q_binary_files(spark, sf):
    return files_of(spark, sf, *WEB).filter(F.col("is_binary")).select("repo", "path")


STRUCT_SQL = files_sql("pages_tree") + """,
pref as (select repo, parts, i, len(parts) as n from files, range(1, len(parts) + 1) t(i)),
nodes as (
  select distinct repo, array_to_string(parts[1:i], '/') as path,
         array_to_string(parts[1:i - 1], '/') as parent_path, parts[i] as name, i < n as is_dir,
         cast(i as integer) as level,
         concat(coalesce(array_to_string(list_transform(parts[1:i - 1], lambda x: concat('0', x, chr(1))), ''), ''),
                case when i < n then '0' else '1' end, parts[i], chr(1)) as tree_key
  from pref
  union all
  select distinct repo, '', cast(null as varchar), repo, true, 0, '' from files)
"""


@register("structure_nodes", STRUCT_SQL + "select repo, path, parent_path, name, is_dir, level from nodes")
def q_structure_nodes(spark, sf):
    return CL.structure_nodes(files_of(spark, sf, "pages_tree")).select(
        "repo", "path", "parent_path", "name", "is_dir", "level")


@register("tree_text", STRUCT_SQL + """
select repo, tree_key, concat(repeat('  ', level), name, case when is_dir then '/' else '' end) as line from nodes
""")
def q_tree_text(spark, sf):
    return CL.tree_text(CL.structure_nodes(files_of(spark, sf, "pages_tree")))


@register("document_lines", files_sql("documents_tree") + """
select repo, path, cast(i as integer) as line_no, cast(strlen(l) as bigint) as n_bytes from (
  select repo, path, unnest(string_split(content, chr(10))) as l,
         unnest(range(1, len(string_split(content, chr(10))) + 1)) as i
  from files where content is not null) t
""")
def q_document_lines(spark, sf):
    return src_lines(files_of(spark, sf, "documents_tree")).select(
        "repo", "path", "line_no", F.octet_length("line").cast("bigint").alias("n_bytes"))


@register("report_overview", STRUCT_SQL + """,
lc as (select repo, language, count(*) n from files group by repo, language),
langs as (select repo, string_agg(concat(language, ' (', n, ' files)'), ', ' order by language) s, sum(n) total
          from lc group by repo),
top as (
  select repo, '000' as key, '' as line from langs
  union all select repo, '001', 'Project Overview:' from langs
  union all select repo, '002', '----------------' from langs
  union all select repo, '003', concat('Name: ', repo) from langs
  union all select repo, '004', concat('Total Files: ', cast(total as bigint)) from langs
  union all select repo, '005', concat('Languages: ', s) from langs
  union all select repo, '006', 'Entry Points: None identified' from langs
  union all select repo, '008', '' from langs
  union all select repo, '009', 'Key Files:' from langs
  union all select repo, '3', '' from langs
  union all select repo, concat('2', tree_key), concat(repeat('  ', level), name, case when is_dir then '/' else '' end)
            from nodes)
select repo, 'project_overview' as section, key, line from top
""")
def q_report_overview(spark, sf):
    from codelake.operators.report import report_overview
    files = files_of(spark, sf, "pages_tree")
    return report_overview(files, CL.structure_nodes(files))


@register("files_by_language", files_sql(*WEB) + "select repo, path from files where language = 'html'")
def q_files_by_language(spark, sf):
    from codelake.sources.corpus import files_by_language
    return files_by_language(files_of(spark, sf, *WEB), "html").select("repo", "path")
