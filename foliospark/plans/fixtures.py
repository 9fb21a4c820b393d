"""Page-model tables derived from the driver's tables, with one text for both engines where they agree."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_PAGE = "cast(floor(l_orderkey/8) as bigint)"
LI = """select cast(floor(l_orderkey/8) as bigint) page_id, l_orderkey ok, cast(l_linenumber as bigint) ln, l_partkey pk, l_suppkey sk,
 cast(l_quantity as bigint) q, cast(round(l_extendedprice*100) as bigint) ep, cast(round(l_discount*100) as bigint) dc, cast(round(l_tax*100) as bigint) tx,
 cast(row_number() over (partition by cast(floor(l_orderkey/8) as bigint) order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 as bigint) seq
from lineitem"""
DETECTIONS = """select page_id, seq det_idx,
 case (pk+sk)%12 when 0 then 'document_title' when 1 then 'paragraph_title' when 2 then 'header' when 3 then 'footer' when 4 then 'page_number'
  when 5 then 'image' when 6 then 'table' when 7 then 'image_caption' when 8 then 'aside_text' else 'text' end label,
 cast(ep%101 as double)/100 score, (pk*7)%700 x1, (sk*131+ln*37)%1100 y1, (pk*7)%700+20+q*6 x2, (sk*131+ln*37)%1100+12+ep%180 y2 from li"""
POLYGONS = """select page_id, sk%3 block_no, cast(row_number() over (partition by page_id, sk%3 order by seq) - 1 as bigint) poly_idx,
 pk%800 x0, ln*28+sk%7 y0, pk%800+5+q*4 x1, ln*28+sk%7+tx y1, pk%800+5+q*4 x2, ln*28+sk%7+tx+10+dc*3 y2, pk%800 x3, ln*28+sk%7+10+dc*3 y3 from li"""
COMPONENTS = """select page_id img_id, seq+1 comp_id, case when pk%4=0 then ep%60+1 else ep%2000+200 end area, pk%900 lft, (sk*13)%600 tp, 1+q wid, 1+q%25+dc hgt from li"""
WORD_SIZES = """select page_id, sk%3 block_no, cast(row_number() over (partition by page_id, sk%3 order by seq) as bigint) word_idx, 10+q*4 w, 6+ep%50 h from li"""
JOB_EVENTS = """select user_id job_id, event_id seq_id, ts, case event_type when 'signup' then 'queued' when 'view' then 'running_preprocess'
 when 'click' then 'running_recognition' when 'purchase' then 'done' else 'failed' end status, props msg from events"""
BATCH_LOG = """select cast(extract(day from ts) as bigint) epoch, event_id batch_id, case when event_id%5=0 then 'val' else 'train' end phase,
 value loss, 1+event_id%16 n, event_id%(2+event_id%16) correct from events"""
#: Whole texts, and the same by line, each a recognised strip.
OCR_PAIRS = """select doc_id, source, text truth, replace(text,'e','c') mat, replace(replace(text,'th','h'),'o','0') raw from documents"""
_STRIPS = """select doc_id, source, cast(p+1 as bigint) line_no, truth, replace(truth,'e','c') mat, replace(replace(truth,'th','h'),'o','0') raw from {source}"""
OCR_STRIPS_SPARK = _STRIPS.format(source="documents lateral view posexplode(split(text, chr(10), -1)) t as p, truth")
OCR_STRIPS_DUCK = _STRIPS.format(source="(select doc_id, source, unnest(string_split(text,chr(10))) truth, generate_subscripts(string_split(text,chr(10)),1)-1 p from documents)")
SAMPLES = """select doc_id sample_id, concat(lang,'_',source) class_name, concat(cast(doc_id as varchar(20)),'.png') file_name from documents"""
_LEVEL = "cast(greatest(0,least(255,floor(({e}{by}+0.5)*255))) as int)"
PX_SPARK = f"""select vec_id img_id, cast(floor(i/8) as bigint) r, cast(i%8 as bigint) c, {_LEVEL.format(e="cast(e as double)", by="")} v,
 {_LEVEL.format(e="cast(element_at(embedding,64-i) as double)", by="*2")} heat from embeddings lateral view posexplode(embedding) t as i, e"""
PX_DUCK = f"""select vec_id img_id, cast(floor(i/8) as bigint) r, cast(i%8 as bigint) c, {_LEVEL.format(e="cast(embedding[i+1] as double)", by="")} v,
 {_LEVEL.format(e="cast(embedding[64-i] as double)", by="*2")} heat from embeddings, range(0,64) t(i)"""
#: The same images as bytes; DuckDB's side of their queries reads px.
RASTERS = f"""select vec_id img_id, unhex(array_join(transform(embedding, e -> lpad(hex({_LEVEL.format(e="cast(e as double)", by="")}),2,'0')),'')) data, 1 nChannels from embeddings"""
_WORDS = """select concat('conv',conv_id) stem, concat(case role when 'user' then 'title' else 'body' end,'_',lpad(cast(turn as varchar(20)),3,'0')) block_id,
 cast({p}+1 as bigint) word_idx, case when ({p}+turn)%11=0 then '' else replace(w,'e','c') end word_mat, replace(w,'o','0') word_raw from {source}"""
WORDS_SPARK = _WORDS.format(p="p", source="conversations lateral view posexplode(split(text,' ')) t as p, w")
WORDS_DUCK = _WORDS.format(p="p", source="(select *, unnest(string_split(text,' ')) w, generate_subscripts(string_split(text,' '),1)-1 p from conversations)")

#: name -> (Spark text, DuckDB text, what it reads)
FIXTURES = {
    "li": (LI, LI, "lineitem"), "detections": (DETECTIONS, DETECTIONS, "li"), "polygons": (POLYGONS, POLYGONS, "li"), "components": (COMPONENTS, COMPONENTS, "li"),
    "word_sizes": (WORD_SIZES, WORD_SIZES, "li"), "job_events": (JOB_EVENTS, JOB_EVENTS, "events"), "batch_log": (BATCH_LOG, BATCH_LOG, "events"),
    "ocr_pairs": (OCR_PAIRS, OCR_PAIRS, "documents"), "ocr_strips": (OCR_STRIPS_SPARK, OCR_STRIPS_DUCK, "documents"), "samples": (SAMPLES, SAMPLES, "documents"), "px": (PX_SPARK, PX_DUCK, "embeddings"), "rasters": (RASTERS, RASTERS, "embeddings"), "ocr_words": (WORDS_SPARK, WORDS_DUCK, "conversations"),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table, or a derived one."""
    if name not in FIXTURES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text, _, source = FIXTURES[name]
    read = table(spark, sf_dir, source)
    if name == "li":  # a page as a column, so that Spark sees that what goes by page later is dealt out already
        text, read = text.replace(f"{_PAGE} page_id", "page_id").replace(_PAGE, "page_id"), read.withColumn("page_id", F.expr(_PAGE))
    return spark.sql(text.replace(f"from {source}", "from {source}"), source=read)


def with_fixtures(sql: str, *names: str) -> str:
    """DuckDB text with the named derived tables in front; sql may start with further ones ("name as (...), ...")."""
    order: list[str] = []
    for n in names:
        chain = []
        while n in FIXTURES:
            chain.append(n)
            n = FIXTURES[n][2]
        order += [c for c in reversed(chain) if c not in order]
    ctes = ", ".join(f"{n} as ({FIXTURES[n][1]})" for n in order)
    plain = sql.lstrip().lower().startswith("select")
    if not ctes:
        return sql if plain else f"with {sql}"
    return f"with {ctes}{' ' if plain else ', '}{sql}"
