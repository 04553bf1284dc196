"""Queries on media, vectors, drives and logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import norm
from ..operators import drives, media, textindex, visual
from ..operators.storage import shared_folder
from .tables import table

TAGS = {"objects": ["rock", "red"], "materials": ["granite"], "scene_tags": ["out", "night"], "content_type": "photo"}


def _segments(spark, sf):
    """Conversations as transcripts: a turn is seven seconds long."""
    c = table(spark, sf, "conversations")
    return c.select(F.col("conv_id").alias("file_id"), F.col("turn").alias("seg"), (F.col("turn") * 17.0 + F.col("conv_id") % 5).alias("start_time"), (F.col("turn") * 17.0 + F.col("conv_id") % 5 + 12.0).alias("end_time"), "role", "text")


def _media_files(spark, sf):
    return table(spark, sf, "conversations").select(F.col("conv_id").alias("file_id")).distinct().select("file_id", F.concat(F.lit("/media/"), F.col("file_id").cast("string"), F.lit(".mp4")).alias("file_path"))


def _topics(spark, sf):
    d = table(spark, sf, "documents")
    return d.select((F.col("doc_id") % 50).alias("file_id"), F.concat(F.col("source"), F.lit(" topic "), (F.col("doc_id") % 7).cast("string")).alias("topic"), (F.col("doc_id") * 1.0).alias("start_time"), ((F.col("doc_id") % 10) / 10).alias("confidence"))


def _keywords(spark, sf):
    d = table(spark, sf, "documents")
    word = F.concat(F.when(F.col("doc_id") % 2 == 0, F.lit("Topic")).otherwise("tOPIC"), (F.col("doc_id") % 3).cast("string"))
    return d.select((F.col("doc_id") % 50).alias("file_id"), word.alias("keyword"), (F.col("doc_id") * 1.0).alias("start_time"), (F.col("doc_id") + 5.0).alias("end_time"))


def q_sentences(spark, sf):
    """Items of speech from all words of documents; a '.' ends an item of its own."""
    d = table(spark, sf, "documents")
    words = d.select(F.col("doc_id").alias("file_id"), F.posexplode(F.regexp_extract_all("text", F.lit(r"([\p{L}]+|[.,])"), 1)).alias("seq", "content"))
    mark = F.col("content").isin(".", ",")
    items = words.select("file_id", "seq", F.when(mark, "punctuation").otherwise("pronunciation").alias("kind"), "content", (F.col("seq") * 0.5 + 1).alias("start_time"), (F.col("seq") * 0.5 + 1.25).alias("end_time"), (F.col("seq") % 4 / 4).alias("confidence"))
    return media.sentences(items).select("file_id", "seg", "start_time", "end_time", "text", F.round("confidence", 6).alias("confidence"))


def q_speakers(spark, sf):
    s = _segments(spark, sf).select("file_id", "seg", "start_time", "end_time")
    who = s.filter("seg % 2 = 0").select("file_id", F.col("start_time"), (F.col("end_time") + 9.0).alias("end_time"), F.concat(F.lit("spk"), (F.col("seg") % 3).cast("string")).alias("speaker"), F.col("seg").alias("ord"))
    return media.with_speakers(s, who).select("file_id", "seg", "speaker")


def q_chunks(spark, sf):
    return media.chunks(_segments(spark, sf)).select("file_id", "chunk", "start_time", "end_time", F.md5("text").alias("text_md5"), "n_segments")


def _fts(spark, sf):
    return table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")


def q_full_text(spark, sf):
    return media.full_text(_fts(spark, sf), "the that", 40).select("id", F.round("score", 5).alias("score"))


def q_indexed_text(spark, sf):
    """The same search from an index."""
    index = textindex.TextIndex.built(_fts(spark, sf), f"{shared_folder(spark)}/text-index", ("words",))
    return index.full_text("the that", 40).select("id", F.round("score", 5).alias("score"))


def q_indexed_like(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    return textindex.TextIndex.built(d, f"{shared_folder(spark)}/text-index", ("parts",)).like(d, "Ing the").select("id")


def q_topic_search(spark, sf):
    return media.search_topics(_topics(spark, sf), media.keyword_frequency(_keywords(spark, sf)), _media_files(spark, sf), "TOPIC 3", 30).select("section", "file_id", "topic", "start_time", "weight")


def q_visual_search(spark, sf):
    d = table(spark, sf, "documents").select((F.col("doc_id") % 50).alias("file_id"), (F.col("doc_id") * 2.5).alias("timestamp"), F.col("text").alias("description"), F.when(F.col("doc_id") % 3 == 0, F.lit("50%_off")).alias("ocr_text"))
    return media.search_visual(d, _media_files(spark, sf), "50%_", 40).select("file_id", "timestamp")


def q_scenes(spark, sf):
    s = table(spark, sf, "events").select((F.col("event_id") % 40).alias("file_id"), (F.floor(F.col("event_id") / 40) * 1000.0).alias("start_time"), (F.floor(F.col("event_id") / 40) * 1000.0 + F.col("event_id") % 517).alias("end_time")).filter("end_time > start_time")
    return media.split_scenes(s)


def q_keyframes(spark, sf):
    f = table(spark, sf, "documents").select(F.col("doc_id").alias("file_id"), (F.col("n_chars") / 4).alias("duration"))
    return media.keyframes(f, 30.0, 100)


def q_clips(spark, sf):
    s = _segments(spark, sf)
    a, b = media.clip_range(F.col("start_time"), F.col("end_time"), F.lit(60.0))
    return s.select("file_id", "seg", a.alias("clip_start"), b.alias("clip_end"), media.storyboard_time(F.col("start_time"), F.col("end_time")).alias("board"))


def q_layers(spark, sf):
    t = _segments(spark, sf).filter("text like '%the%'").select("file_id", "start_time", "role")
    seen = table(spark, sf, "documents").filter("doc_id % 3 = 0").select((F.col("doc_id") % 50).alias("file_id"), (F.col("doc_id") * 2.5).alias("start_time"))
    return media.layers(t, _topics(spark, sf).select("file_id", "start_time", "topic"), seen).select("type", "file_id", "start_time", "role", "topic")


def q_norms(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", F.round(norm("embedding"), 4).alias("norm"))


def q_similar(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("v"))
    q = e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "v")
    return visual.similar(e, q, 5, 0.3).select("query_id", "rank", "vec_id", F.round("score", 4).alias("score"))


def _frames(spark, sf):
    d = table(spark, sf, "documents")
    k = F.col("doc_id")
    obj = F.array(F.struct(F.when(k % 3 == 0, F.lit("Big Rock")).otherwise("tree").alias("name"), F.array(F.when(k % 2 == 0, F.lit("Red")).otherwise("tall")).alias("attributes")))
    return d.select(k.alias("frame_id"), F.struct(obj.alias("objects"), F.array(F.when(k % 5 == 0, F.lit("granite")).otherwise("wood")).alias("materials"), F.array(F.lit("Outdoor"), F.when(k % 7 == 0, F.lit("night")).otherwise("day")).alias("scene_tags"), F.when(k % 11 == 0, F.lit("photograph")).otherwise("drawing").alias("content_type")).alias("tags"))


def q_tags(spark, sf):
    return visual.search_tags(_frames(spark, sf), TAGS, 0.5, 100).select("frame_id", "score")


def q_both(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("v"))
    return visual.search_both(_frames(spark, sf), e, e.filter("vec_id = 3").select(F.col("vec_id").alias("query_id"), "v"), TAGS, 10).select("frame_id", F.round("tag_score", 6).alias("tag_score"))


def _nodes(spark, sf):
    d = table(spark, sf, "documents")
    parent = F.when(F.col("doc_id") % 40 == 1, F.lit("gone")).otherwise(F.concat(F.lit("n"), F.floor(F.col("doc_id") / 7).cast("string")))
    return d.select(F.concat(F.lit("n"), F.col("doc_id").cast("string")).alias("id"), F.when(F.col("doc_id") == 0, F.lit("")).otherwise(parent).alias("parent"), F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("name"))


def q_paths(spark, sf):
    return drives.paths(_nodes(spark, sf)).select("id", "rel_path", "depth")


def q_index(spark, sf):
    d = table(spark, sf, "documents")
    k = F.col("doc_id")
    listing = d.select(F.when(k % 13 == 0, F.lit("")).otherwise(F.concat(F.lit(" i"), k.cast("string"))).alias("id"), F.col("source").alias("name"), F.when(k % 2 == 0, F.lit(" p1 ")).alias("parents.0.id"), F.when(k % 3 == 0, F.lit("p2")).otherwise("").alias("parents.0"), F.lit("p3").alias("parents"), F.when(k % 5 == 0, F.lit("application/vnd.google-apps.folder")).otherwise("text/plain").alias("mimeType"), F.upper(F.md5("text")).alias("md5Checksum"), F.when(k % 4 == 0, F.lit("12x")).otherwise(k.cast("string")).alias("size"))
    return drives.index(listing)


def q_targets(spark, sf):
    d = table(spark, sf, "documents")
    p = F.concat(F.when(F.col("doc_id") % 3 == 0, F.lit("My Drive/")).when(F.col("doc_id") % 3 == 1, F.lit("Main/")).otherwise(""), F.col("source"), F.lit("/a:b./x"))
    mime = F.when(F.col("doc_id") % 2 == 0, F.lit("application/vnd.google-apps.document")).otherwise("text/plain")
    return d.select("doc_id", drives.target_dir(p, "Main").alias("target"), drives.office_path(p, mime).alias("office"))


def _folder_sets(spark, sf):
    d = table(spark, sf, "documents")
    disk = d.select(F.concat(F.lit("res"), (F.col("doc_id") % 12).cast("string")).alias("resource"), F.concat(F.lit(" Folder  "), (F.col("doc_id") % 17).cast("string")).alias("folder"))
    drive = d.filter("doc_id % 3 = 0").select(F.concat(F.lit("drive"), (F.col("doc_id") % 8).cast("string")).alias("drive"), F.concat(F.lit("folder "), (F.col("doc_id") % 19).cast("string")).alias("folder"))
    return disk, drive


def q_drive_match(spark, sf):
    disk, drive = _folder_sets(spark, sf)
    return drives.match_folders(disk, drive, least=0.3)


def q_display(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.concat(F.lit("name"), (F.col("doc_id") % 300).cast("string")).alias("name"))
    return drives.display_names(d, "name", "doc_id").select("doc_id", "display_name")


def q_overlay(spark, sf):
    d = table(spark, sf, "documents")
    auto = d.filter("doc_id % 2 = 0").select("doc_id", F.concat(F.lit("auto"), F.col("doc_id").cast("string")).alias("name"))
    manual = d.filter("doc_id % 3 = 0").select("doc_id", F.when(F.col("doc_id") % 9 == 0, F.lit("")).otherwise("hand").alias("name"))
    return drives.overlay(auto, manual, "doc_id", "name")


def q_recent_log(spark, sf):
    e = table(spark, sf, "events")
    return e.filter("event_type = 'click'").orderBy(F.desc("ts"), F.desc("event_id")).limit(50).select("event_id", "user_id")


def q_throughput(spark, sf):
    from pyspark.sql import Window

    e = table(spark, sf, "events")
    t = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rate = F.col("value") / F.greatest(t - F.lag(t).over(w), F.lit(1.0))
    return e.select("event_id", F.round(rate, 6).alias("rate"))


def q_windows(spark, sf):
    e = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("hour"), "event_type", "n")


QUERIES = {
    "ag21_sentences": q_sentences,
    "jn24_speakers": q_speakers,
    "ag22_chunks": q_chunks,
    "ag23_keyword_frequency": lambda s, d: media.keyword_frequency(_keywords(s, d)).drop("key"),
    "ag30_speakers_detected": lambda s, d: q_speakers(s, d).groupBy("file_id").agg(F.countDistinct("speaker").alias("speakers")),
    "so08_full_text": q_full_text,
    "so08_indexed_text": q_indexed_text,
    "q06_indexed_like": q_indexed_like,
    "so09_topic_search": q_topic_search,
    "jn21_visual_search": q_visual_search,
    "fn44_scenes": q_scenes,
    "fn43_keyframes": q_keyframes,
    "fn45_clips": q_clips,
    "set08_layers": q_layers,
    "fn47_norms": q_norms,
    "so10_similar": q_similar,
    "so11_tags": q_tags,
    "so12_tags_and_vectors": q_both,
    "jn25_paths": q_paths,
    "src11_drive_index": q_index,
    "fn26_targets": q_targets,
    "jn18_drive_match": q_drive_match,
    "wn09_display_names": q_display,
    "jn37_overlay": q_overlay,
    "prj26_recent_log": q_recent_log,
    "fn53_throughput": q_throughput,
    "st07_event_windows": q_windows,
}

_SEG = "sg as (select conv_id as file_id, turn as seg, (turn*17.0 + conv_id % 5)::double as start_time, (turn*17.0 + conv_id % 5 + 12.0)::double as end_time, role, text from conversations)"
_MF = "mf as (select distinct conv_id as file_id from conversations)"
_KW = "kw as (select doc_id % 50 as file_id, case when doc_id % 2 = 0 then 'Topic' else 'tOPIC' end || (doc_id % 3) as keyword, doc_id*1.0 as st, doc_id + 5.0 as en from documents), kf as (select file_id, arg_min(keyword, st) as keyword, min(st)::double as start_time, max(en)::double as end_time, count(*) as frequency from kw group by file_id, lower(keyword))"
_SP = "sp as (select file_id, seg as ord, start_time as s, end_time + 9.0 as e, 'spk' || (seg % 3) as speaker from sg where seg % 2 = 0), ss as (select sg.file_id, sg.seg, (select arg_min(speaker, ord) from sp where sp.file_id = sg.file_id and sp.s <= (sg.start_time+sg.end_time)/2 and (sg.start_time+sg.end_time)/2 <= sp.e) as speaker from sg)"
_P = "(case doc_id % 3 when 0 then 'My Drive/' when 1 then 'Main/' else '' end || source || '/a:b./x')"
_DOT = "list_sum(list_transform(range(1, 65), lambda i: a.embedding[i]::double * b.embedding[i]::double))"
_NORM = "sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double)))"
SQL = {
    "ag21_sentences": """with w as (select doc_id as file_id, regexp_extract_all(text, '([\\p{L}]+|[.,])', 1) as l from documents), i as (select file_id, unnest(range(0, len(l))) as seq, unnest(l) as content from w),
m as (select *, content in ('.', ',') as p, coalesce(sum((content = '.')::int) over (partition by file_id order by seq rows between unbounded preceding and 1 preceding), 0) as seg from i),
g as (select file_id, seg, min(case when not p then seq*0.5+1 end) as st, max(case when not p then seq*0.5+1.25 end) as en, trim(string_agg(case when p then content else ' ' || content end, '' order by seq)) as text, avg(case when not p then (seq % 4)/4.0 end) as cf from m group by file_id, seg)
select file_id, seg::bigint as seg, coalesce(st, 0)::double as start_time, coalesce(en, 0)::double as end_time, text, round(coalesce(cf, 0), 6)::double as confidence from g where text <> ''""",
    "jn24_speakers": f"with {_SEG}, {_SP} select * from ss",
    "ag30_speakers_detected": f"with {_SEG}, {_SP} select file_id, count(distinct speaker) as speakers from ss group by file_id",
    "ag22_chunks": f"""with recursive {_SEG}, o as (select *, row_number() over (partition by file_id order by start_time, end_time, text) as r from sg),
t as (select file_id, r, start_time, end_time, text, start_time as anchor, 1 as chunk from o where r = 1 union all select o.file_id, o.r, o.start_time, o.end_time, o.text, case when o.start_time - t.anchor > 60 then o.start_time else t.anchor end, case when o.start_time - t.anchor > 60 then t.chunk + 1 else t.chunk end from t join o on o.file_id = t.file_id and o.r = t.r + 1)
select file_id, chunk, min(start_time) as start_time, max(end_time) as end_time, md5(string_agg(text, ' ' order by r)) as text_md5, count(*) as n_segments from t group by file_id, chunk""",
    "ag23_keyword_frequency": f"with {_KW} select * from kf",
    "so08_full_text": """with d as (select conv_id*1000+turn as id, regexp_extract_all(lower(text), '([\\p{L}\\p{N}]+)', 1) as t from conversations), c as (select id, len(t) as n, len(list_filter(t, lambda x: x='the')) as a, len(list_filter(t, lambda x: x='that')) as b from d),
s as (select count(*) as docs, avg(n) as mean, count(*) filter (where a>0) as da, count(*) filter (where b>0) as db from c), f as (select id, greatest(ln((docs-da+0.5)/(da+0.5)),1e-6)*a*2.2/(a+1.2*(0.25+0.75*n/mean)) + greatest(ln((docs-db+0.5)/(db+0.5)),1e-6)*b*2.2/(b+1.2*(0.25+0.75*n/mean)) as s from c, s where a>0 and b>0)
select id, round(s, 5) as score from f order by round(s, 9) desc, id limit 40""",
    "so09_topic_search": f"with {_MF}, {_KW}, r as (select 0 as section, doc_id % 50 as file_id, source || ' topic ' || (doc_id % 7) as topic, (doc_id*1.0)::double as start_time, ((doc_id % 10)/10.0)::double as weight from documents union all select 1, file_id, keyword, start_time, frequency::double from kf) select section, file_id, topic, start_time, weight from r where topic ilike '%TOPIC 3%' and file_id in (select file_id from mf) order by section, weight desc, file_id, topic, start_time limit 30",
    "jn21_visual_search": f"with {_MF} select doc_id % 50 as file_id, (doc_id*2.5)::double as timestamp from documents where (contains(lower(text), '50%_') or doc_id % 3 = 0) and doc_id % 50 in (select file_id from mf) order by 2, 1 limit 40",
    "fn44_scenes": "with s as (select event_id % 40 as file_id, (event_id // 40)*1000.0 as st, (event_id // 40)*1000.0 + event_id % 517 as en from events where event_id % 517 > 0), p as (select file_id, st, en, greatest(ceil((en-st)/120.0),1)::int as n, unnest(range(0, greatest(ceil((en-st)/120.0),1)::int)) as k from s), q as (select file_id, (st+k*120.0)::double as start_time, least(st+(k+1)*120.0, en)::double as end_time, n > 1 as forced_split from p) select *, row_number() over (partition by file_id order by start_time) - 1 as scene_index from q",
    "fn43_keyframes": "with f as (select doc_id as file_id, least(ceil(n_chars/4.0/30.0), 100)::int as n from documents where n_chars > 0), g as (select file_id, unnest(range(0, n)) as frame from f) select file_id, frame, (frame*30.0)::double as timestamp from g",
    "fn45_clips": f"with {_SEG} select file_id, seg, greatest(start_time-0.5, 0)::double as clip_start, least(end_time+0.5, 60.0)::double as clip_end, start_time + least(1.0, 0.1*(end_time-start_time)) as board from sg",
    "set08_layers": f"with {_SEG} select 'transcript' as type, file_id, start_time, role, null::varchar as topic from sg where text like '%the%' union all select 'topic', doc_id % 50, (doc_id*1.0)::double, null, source || ' topic ' || (doc_id % 7) from documents union all select 'visual', doc_id % 50, (doc_id*2.5)::double, null, null from documents where doc_id % 3 = 0",
    "fn47_norms": f"select vec_id, round({_NORM}, 4) as norm from embeddings",
    "so10_similar": f"with u as (select vec_id, embedding, {_NORM} as n from embeddings), c as (select a.vec_id as query_id, b.vec_id, round({_DOT}/(a.n*b.n), 6) as s from u a, u b where a.vec_id % 50 = 0), r as (select *, row_number() over (partition by query_id order by s desc, vec_id) as rank from c where s >= 0.3) select query_id, rank, vec_id, round(s, 4) as score from r where rank <= 5",
    "so11_tags": "with f as (select doc_id as frame_id, round(((((doc_id % 3 = 0)::int + (doc_id % 2 = 0)::int)/2.0) + (doc_id % 5 = 0)::int + (1 + (doc_id % 7 = 0)::int)/2.0 + (doc_id % 11 = 0)::int)/4.0, 6)::double as score from documents) select * from f where score >= 0.5 order by score desc, frame_id limit 100",
    "so12_tags_and_vectors": f"with u as (select vec_id, embedding, {_NORM} as n from embeddings), c as (select b.vec_id, round({_DOT}/(a.n*b.n), 6) as s from u a, u b where a.vec_id = 3), r as (select *, row_number() over (order by s desc, vec_id) as rank from c where s >= 0.2), f as (select doc_id as frame_id, ((((doc_id % 3 = 0)::int + (doc_id % 2 = 0)::int)/2.0) + (doc_id % 5 = 0)::int + (1 + (doc_id % 7 = 0)::int)/2.0 + (doc_id % 11 = 0)::int)/4.0 as t from documents) select frame_id, round(t, 6)::double as tag_score from f join r on r.vec_id = frame_id where rank <= 20 and t >= 0.3 order by s desc, frame_id limit 10",
    "jn25_paths": "with recursive n as (select 'n' || doc_id as id, case when doc_id = 0 then '' when doc_id % 40 = 1 then 'gone' else 'n' || (doc_id // 7) end as parent, 'f' || doc_id as name from documents), t as (select id, name as rel_path, 1 as depth from n where parent not in (select id from n) union all select n.id, t.rel_path || '/' || n.name, t.depth + 1 from t join n on n.parent = t.id) select * from t",
    "src11_drive_index": "select trim(' i' || doc_id) as id, source as name, case when doc_id % 2 = 0 then 'p1' when doc_id % 3 = 0 then 'p2' else 'p3' end as parent, case when doc_id % 5 = 0 then 'application/vnd.google-apps.folder' else 'text/plain' end as mime, md5(text) as md5, case when doc_id % 4 = 0 then null else doc_id end as size, doc_id % 5 = 0 as is_folder from documents where doc_id % 13 <> 0",
    "fn26_targets": f"select doc_id, source || '/a_b/x' as target, case when doc_id % 2 = 0 then {_P} || '.docx' else {_P} end as office from documents",
    "jn18_drive_match": """with d as (select distinct 'res' || (doc_id % 12) as resource, 'folder ' || (doc_id % 17) as folder from documents), r as (select distinct 'drive' || (doc_id % 8) as drive, 'folder ' || (doc_id % 19) as folder from documents where doc_id % 3 = 0),
s as (select resource, drive, count(*) as k from d join r using (folder) group by all), c as (select s.*, k/((select count(*) from d x where x.resource=s.resource) + (select count(*) from r y where y.drive=s.drive) - k)::double as score from s),
b as (select *, row_number() over w as rank, coalesce(lead(score) over w, 0) as second from c window w as (partition by resource order by score desc, drive)), u as (select distinct resource from d)
select u.resource, case when coalesce(score,0) >= 0.3 then drive end as drive, round(coalesce(score,0),6) as score, round(coalesce(second,0),6) as runner_up, coalesce(score >= 0.3 and score-second < 0.15 and second > 0.3, false) as ambiguous from u left join b on b.resource=u.resource and b.rank=1""",
    "wn09_display_names": "select doc_id, 'name' || (doc_id % 300) || case when row_number() over (partition by doc_id % 300 order by doc_id) > 1 then ' (' || row_number() over (partition by doc_id % 300 order by doc_id) || ')' else '' end as display_name from documents",
    "jn37_overlay": "select doc_id, case when doc_id % 3 = 0 and doc_id % 9 <> 0 then 'hand' else 'auto' || doc_id end as name, doc_id % 3 = 0 and doc_id % 9 <> 0 as manual from documents where doc_id % 2 = 0 or (doc_id % 3 = 0 and doc_id % 9 <> 0)",
    "prj26_recent_log": "select event_id, user_id from events where event_type = 'click' order by ts desc, event_id desc limit 50",
    "fn53_throughput": "select event_id, round(value / greatest(epoch(ts) - lag(epoch(ts)) over (partition by user_id order by ts, event_id), 1.0), 6) as rate from events",
    "st07_event_windows": "select strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') as hour, event_type, count(*) as n from events group by 1, 2",
}
SQL |= {"so08_indexed_text": SQL["so08_full_text"], "q06_indexed_like": "select doc_id as id from documents where contains(lower(text), 'ing the')"}
