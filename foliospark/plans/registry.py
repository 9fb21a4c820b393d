"""Queries by name, each with its oracle SQL where DuckDB can express it."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliospark.functions import geometry as g
from foliospark.functions import models
from foliospark.functions import texts as x
from foliospark.operators import components, lines, quality, raster, regions, report, training
from foliospark.plans.fixtures import table, with_fixtures
from foliospark.sources import files

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(*sources: str, sql: str | None = None, also: str = ""):
    """Registers a function of the named tables. sql runs over the same tables; also names parts it shares with other queries."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(*(table(spark, sf_dir, s) for s in sources))
        if sql:
            ORACLES[f.__name__] = with_fixtures(f"{also}{sql}", *sources)
        return f

    return add


# -- regions

_LABELS = ", ".join(f"'{v}'" for v in g.TEXT_LABELS)
_IOMIN_OF = "case when least(a.x2,b.x2)>greatest(a.x1,b.x1) and least(a.y2,b.y2)>greatest(a.y1,b.y1) and least((a.x2-a.x1)*(a.y2-a.y1),(b.x2-b.x1)*(b.y2-b.y1))>0 then cast((least(a.x2,b.x2)-greatest(a.x1,b.x1))*(least(a.y2,b.y2)-greatest(a.y1,b.y1)) as double)/least((a.x2-a.x1)*(a.y2-a.y1),(b.x2-b.x1)*(b.y2-b.y1)) else 0 end"


def _io_min(one: str, other: str) -> str:
    """The overlap of two named boxes."""
    return re.sub(r"\b[ab]\.", lambda m: f"{one if m[0] == 'a.' else other}.", _IOMIN_OF)


_IOMIN = _io_min("a", "b")
_TEXT = f"""kept as (select *, case when label in ('header','page_number') then 'header' when label='footer' then 'footer' when label in ('document_title','paragraph_title') then 'title' else 'body' end category
 from detections where score>=0.2 and label in ({_LABELS})), """
_CHOSEN = """flagged as (select *, max(case when category='title' then 1 else 0 end) over (partition by page_id) has_title from kept),
 ranked as (select *, row_number() over (partition by page_id order by (x2-x1)*(y2-y1) desc, det_idx) rk from flagged where has_title=0 or category='title'),
 chosen as (select * from ranked where has_title=1 or rk<=3), """
_FOLD = _io_min("b", "k")
_NMS = f"""lists as (select page_id, list([{{'rk':rk,'det_idx':det_idx,'category':category,'label':label,'score':score,'x1':x1,'y1':y1,'x2':x2,'y2':y2}}] order by rk) bs from chosen group by page_id),
 folded as (select page_id, list_reduce(bs, lambda acc, one: case when len(list_filter(acc, lambda k: list_transform(one, lambda b: {_FOLD})[1] > 0.6))>0 then acc else list_concat(acc, one) end) bs from lists),
 regions as (select page_id, unnest(bs) b from folded), """


@query("detections", also=_TEXT + _CHOSEN + _NMS, sql="""final as (select 1)
 select page_id, cast(row_number() over (partition by page_id order by floor(b.y1/100), b.x1, b.rk) as bigint) as position, printf('%s_%03d', b.category, b.det_idx) box_id, b.category category, b.score score, b.x1 x1, b.y1 y1, b.x2 x2, b.y2 y2 from regions""")
def title_regions(d):
    return regions.title_regions(d).select("page_id", "position", "box_id", "category", "score", "x1", "y1", "x2", "y2")


@query("detections", also=_TEXT, sql="final as (select 1) select page_id, det_idx, category, printf('%s_%03d', category, det_idx) box_id, (x2-x1)*(y2-y1) area, score from kept")
def text_detections(d):
    return regions.text_detections(d).select("page_id", "det_idx", "category", "box_id", g.area(regions._cols()).alias("area"), "score")


@query("detections", also=_TEXT + _CHOSEN, sql="final as (select 1) select page_id, det_idx, category, cast(rk as bigint) as rk, has_title=1 has_title from chosen")
def title_or_fallback(d):
    return regions.title_or_fallback(regions.text_detections(d)).select("page_id", "det_idx", "category", F.col("rank").cast("bigint").alias("rk"), "has_title")


@query("detections", also=_TEXT + _CHOSEN, sql=f"final as (select 1) select a.page_id, a.det_idx a_idx, b.det_idx b_idx, round({_IOMIN}, 9) overlap from chosen a join chosen b on a.page_id=b.page_id and a.det_idx<b.det_idx where {_IOMIN} > 0.6")
def overlap_pairs(d):
    return regions.overlap_pairs(regions.title_or_fallback(regions.text_detections(d)))


@query("detections", also=_TEXT + _CHOSEN + _NMS, sql=f"""k as (select page_id, count(*) n from regions group by page_id)
 select d.page_id, count(*) n_raw, count(*) filter (where score>=0.2 and label in ({_LABELS})) n_text, coalesce(max(k.n),0) n_kept from detections d left join k on k.page_id=d.page_id group by d.page_id""")
def region_counts(d):
    return regions.region_counts(d)


@query("detections", sql=f"""w as (select *, case when score<0.2 then 'low score' else 'not text' end why from detections where not (score>=0.2 and label in ({_LABELS})))
 select page_id, string_agg(printf('%03d %s: %s', det_idx, label, why), '; ' order by det_idx) warnings, count(*) n_rejected from w group by page_id""")
def rejected_warnings(d):
    return regions.rejected_warnings(d)


@query("detections", sql="select page_id, det_idx, greatest(0,x1-10) cx1, greatest(0,y1-10) cy1, least(800,x2+10) cx2, least(1200,y2+10) cy2 from detections")
def crop_windows(d):
    return regions.crop_windows(d, 800, 1200)


@query("detections", also=_TEXT + _CHOSEN + _NMS, sql="""p as (select page_id, row_number() over (partition by page_id order by floor(b.y1/100), b.x1, b.rk) pos, b from regions)
 select page_id, '{"width":800,"height":1200}' image_size, string_agg(printf('{"label":"%s","polygon":[[%d,%d],[%d,%d],[%d,%d],[%d,%d]]}', printf('%s_%03d', b.category, b.det_idx), b.x1,b.y1,b.x2,b.y1,b.x2,b.y2,b.x1,b.y2), ',' order by pos) boxes from p group by page_id""")
def page_metadata(d):
    m = regions.page_metadata(regions.title_regions(d), 800, 1200)
    return m.select("page_id", F.to_json("image_size").alias("image_size"), F.array_join(F.transform("boxes", lambda b: F.to_json(F.struct(b.label, b.polygon))), ",").alias("boxes"))


# -- lines and words

_GEO = """geo as (select *, least(x0,x1,x2,x3) bx1, least(y0,y1,y2,y3) by1, greatest(x0,x1,x2,x3) bx2, greatest(y0,y1,y2,y3) by2, (x0+x1+x2+x3)/4.0 cx, (y0+y1+y2+y3)/4.0 cy, greatest(y0,y1,y2,y3)-least(y0,y1,y2,y3) height,
 greatest(sqrt(cast((x0-x1)*(x0-x1)+(y0-y1)*(y0-y1) as double)), sqrt(cast((x3-x2)*(x3-x2)+(y3-y2)*(y3-y2) as double))) ew, greatest(sqrt(cast((x0-x3)*(x0-x3)+(y0-y3)*(y0-y3) as double)), sqrt(cast((x1-x2)*(x1-x2)+(y1-y2)*(y1-y2) as double))) eh from polygons),
 sized as (select *, cast(floor(ew) as bigint) w, cast(floor(eh) as bigint) h, greatest(1,cast(floor(round(ew*1.02,6)) as bigint)) cw, greatest(1,cast(floor(round(eh*1.02,6)) as bigint)) ch from geo),
 steps as (select *, avg(height) over (partition by page_id, block_no) avg_h, lag(cy) over (partition by page_id, block_no order by cy, poly_idx) was, row_number() over (partition by page_id, block_no order by cy, poly_idx) y_rank from sized),
 lined as (select *, cast(sum(case when abs(cy-was)>=0.5*avg_h then 1 else 0 end) over (partition by page_id, block_no order by cy, poly_idx rows unbounded preceding) as bigint) line_no from steps),
 numbered as (select *, cast(row_number() over (partition by page_id, block_no order by line_no, cx, y_rank) as bigint) word_no from lined), """


@query("polygons", also=_GEO, sql="final as (select 1) select page_id, block_no, poly_idx, bx1, by1, bx2, by2, cast(cx as double) cx, cast(cy as double) cy, height, w, h, cw, ch from sized")
def polygon_geometry(p):
    return lines.polygon_geometry(p).select("page_id", "block_no", "poly_idx", "bx1", "by1", "bx2", "by2", "cx", "cy", "height", "w", "h", "cw", "ch")


@query("polygons", also=_GEO, sql="final as (select 1) select page_id, block_no, poly_idx, line_no, word_no, round(avg_h,6) avg_h from numbered")
def line_groups(p):
    return lines.group_lines(p).select("page_id", "block_no", "poly_idx", "line_no", "word_no", F.round("avg_h", 6).alias("avg_h"))


@query("polygons", also=_GEO, sql="final as (select 1) select page_id, block_no, word_no, w, h, cw, ch from numbered where w>=h and ch>=8 and cw>=20")
def kept_words(p):
    return lines.keep_words(lines.group_lines(p)).select("page_id", "block_no", "word_no", "w", "h", "cw", "ch")


def _blocks(p):
    return p.select("page_id").distinct().select("page_id", F.explode(F.sequence(F.lit(0), F.lit(3)).cast("array<bigint>")).alias("block_no")).withColumn("bx", F.col("block_no") * 100).withColumn("by", F.pmod("page_id", F.lit(50)))


_BLOCKS = "blocks as (select page_id, b block_no, b*100 bx, page_id%50 as by_ from (select distinct page_id from polygons), range(0,4) t(b)), "


@query("polygons", also=_GEO + _BLOCKS, sql="""seen as (select distinct page_id, block_no from polygons), kept as (select * from numbered where w>=h and ch>=8 and cw>=20)
 select b.page_id, b.block_no, word_no, case when word_no is not null then printf('block_%03d_word_%03d', b.block_no, word_no) end word_id, bx+bx1 ax1, by_+by1 ay1, bx+bx2 ax2, by_+by2 ay2
 from blocks b join seen using (page_id, block_no) left join kept k on k.page_id=b.page_id and k.block_no=b.block_no""")
def block_words(p):
    w = lines.block_words(_blocks(p), p)
    return w.withColumn("word_id", F.when(F.col("word_no").isNotNull(), F.col("word_id")))


@query("polygons", also=_GEO + _BLOCKS, sql="""seen as (select distinct page_id, block_no from polygons), kept as (select * from numbered where w>=h and ch>=8 and cw>=20)
 select s.page_id, s.block_no, count(k.word_no) n_words, coalesce(string_agg(printf('block_%03d_word_%03d', s.block_no, word_no), ',' order by word_no), '') word_ids from seen s left join kept k on k.page_id=s.page_id and k.block_no=s.block_no group by s.page_id, s.block_no""")
def block_metadata(p):
    m = lines.block_metadata(lines.block_words(_blocks(p), p))
    return m.select("page_id", "block_no", F.size("words").cast("bigint").alias("n_words"), F.array_join(F.transform("words", lambda w: w.word_id), ",").alias("word_ids"))


@query("word_sizes", sql="""s as (select *, greatest(1,cast(floor(w*(384.0::double/h)) as bigint)) sw, case when 384.0::double/h<1 then 'area' else 'cubic' end resample from word_sizes),
 o as (select *, cast(coalesce(sum(sw+40) over (partition by page_id, block_no order by word_idx rows between unbounded preceding and 1 preceding),0) as bigint) x_offset, cast(sum(sw) over (partition by page_id, block_no)+40*(count(*) over (partition by page_id, block_no)-1) as bigint) total from s)
 select page_id, block_no, word_idx, sw, resample, x_offset, total from o where total<=15000""")
def strip_plan(s):
    return lines.strip_plan(s).select("page_id", "block_no", "word_idx", "sw", "resample", "x_offset", "total")


@query("word_sizes", sql="""r as (select *, row_number() over (partition by page_id order by w desc, block_no*1000+word_idx) n from word_sizes where h>=22)
 select page_id, block_no*1000+word_idx frame, h glyph_h, w sharpness, round(least(1.0::double, 24.0::double/h),9) scale from r where n=1""")
def usable_frames(s):
    f = s.select("page_id", (F.col("block_no") * 1000 + F.col("word_idx")).alias("frame"), F.col("h").alias("glyph_h"), F.col("w").alias("sharpness"))
    return lines.usable_frames(f).withColumn("scale", F.round("scale", 9))


# -- pixels

_HIST = "hist as (select img_id, v, count(*) n from px group by img_id, v), "
_OTSU = """cum as (select *, sum(n) over u w0, sum(n*v) over u m0, sum(n) over (partition by img_id) total, sum(n*v) over (partition by img_id) mass from hist window u as (partition by img_id order by v rows unbounded preceding)),
 var as (select *, case when w0<total then cast(mass*w0-total*m0 as double)*cast(mass*w0-total*m0 as double)/cast(w0*(total-w0) as double) else 0 end var from cum),
 otsu as (select img_id, v t from (select *, row_number() over (partition by img_id order by var desc, v) k from var) where k=1), """


@query("px", also=_HIST, sql="final as (select 1) select img_id, v, n from hist")
def grey_histogram(p):
    return raster.histogram(p)


@query("px", also=_HIST + _OTSU, sql="final as (select 1) select img_id, t from otsu")
def otsu_threshold(p):
    return raster.otsu(p)


@query("px", also=_HIST + _OTSU, sql="c as (select p.img_id, t, count(*) filter (where v>t) white, count(*) filter (where v<=t) black from px p join otsu using (img_id) group by p.img_id, t) select img_id, t, white, black, white>black inverted from c")
def foreground(p):
    return raster.foreground(p)


@query("rasters")
def image_thresholds(images):
    """From an image's bytes to its threshold in one pass; the SQL goes by pixels."""
    return raster.image_thresholds(images)


ORACLES["image_thresholds"] = with_fixtures(_HIST + _OTSU + "c as (select p.img_id, t, count(*) filter (where v>t) paper, count(*) filter (where v<=t) ink from px p join otsu using (img_id) group by p.img_id, t) select img_id, t threshold, ink, paper, paper>ink inverted from c", "px")


_SMOOTH = "dense as (select img_id, l v from (select distinct img_id from px), range(0,256) t(l)), smooth as (select d.img_id, d.v, cast(sum(coalesce(n,0)) over (partition by d.img_id order by d.v rows between 7 preceding and 7 following) as bigint) win from dense d left join hist h on h.img_id=d.img_id and h.v=d.v), "


@query("px", also=_HIST + _SMOOTH, sql="final as (select 1) select img_id, v, win window_sum, round(win/15.0::double,9) smooth from smooth where win>0")
def smoothed_histogram(p):
    return raster.smoothed_histogram(p).filter("window > 0").select("img_id", F.col("v").cast("bigint").alias("v"), F.col("window").alias("window_sum"), F.round("smooth", 9).alias("smooth"))


def _votes(patch: int, side: int = 8) -> str:
    top, bottom, left, right = (f"{x}{t}" for x, t in (("r", f"<{patch}"), ("r", f">={side - patch}"), ("c", f"<{patch}"), ("c", f">={side - patch}")))
    corners = "+".join(f"avg(v) filter (where {x} and {y})" for x in (top, bottom) for y in (left, right))
    times = "+".join(f"({z})::int" for z in (top, bottom, left, right))
    return f"""z as (select img_id, ({corners})/4 corner_mean, sum(v*({times}))/sum({times})::double border_mean from px group by img_id),
 m as (select img_id, sum(win) filter (where v<128) low, sum(win) filter (where v>=128) high from smooth group by img_id)
 select img_id, round(corner_mean,6) corner_mean, round(border_mean,6) border_mean, cast((corner_mean<128)::int+(border_mean<128)::int+(low>high)::int as bigint) votes, (corner_mean<128)::int+(border_mean<128)::int+(low>high)::int>=2 is_dark from z join m using (img_id)"""


@query("px", also=_HIST + _SMOOTH, sql=_votes(2))
def polarity_vote(p):
    return raster.polarity_vote(p, 2)


@query("px", also=_HIST + _SMOOTH, sql=_votes(5))
def polarity_vote_by_size(p):
    """The patch follows the image's size: five pixels here."""
    return raster.polarity_vote(p)


_HEAT = """lv as (select p.*, t, min(v) over (partition by p.img_id) lo, max(v) over (partition by p.img_id) hi, (r=0)::int+(r=7)::int+(c=0)::int+(c=7)::int times from px p join otsu on otsu.img_id=p.img_id),
 lw as (select *, case when hi>lo then case when v>t then 255 else 0 end else v end lev from lv),
 hs as (select img_id, count(*) filter (where heat>127) n_text, count(*) filter (where heat<64) n_back, quantile_cont(v,0.5) filter (where heat>127) tm, quantile_cont(v,0.5) filter (where heat<64) bm, avg(lev) filter (where r between 2 and 5 and c between 2 and 5) cm, sum(lev*times)/sum(times)::double bord from lw group by img_id),
 bx as (select img_id, quantile_cont(v,0.5) bmed from (select img_id, v from px where r=0 union all select img_id, v from px where r=7 union all select img_id, v from px where c=0 union all select img_id, v from px where c=7) group by img_id),
 hp as (select img_id, n_text, n_back, n_text>10 and n_back>10 by_heat, case when n_text>10 and n_back>10 then tm>bm else cm>bord end is_dark, bm, bmed from hs join bx using (img_id)), """


@query("px", also=_HIST + _OTSU + _HEAT, sql="final as (select 1) select img_id, n_text, n_back, by_heat, is_dark, cast(case when not by_heat then floor(bmed) when n_back>10 then floor(bm) when is_dark then 0 else 255 end as bigint) pad from hp")
def heat_polarity(p):
    return raster.heat_polarity(p)


_CHANNELS = "ch as (select *, (v*3)%256 g, 255-v b from px), bc as (select img_id, quantile_cont(v,0.5) filter (where heat<64) v_back, quantile_cont(g,0.5) filter (where heat<64) g_back, quantile_cont(b,0.5) filter (where heat<64) b_back from ch group by img_id), bo as (select img_id, quantile_cont(v,0.5) v_border, quantile_cont(g,0.5) g_border, quantile_cont(b,0.5) b_border from (select * from ch where r=0 union all select * from ch where r=7 union all select * from ch where c=0 union all select * from ch where c=7) group by img_id), "


@query("px", also=_HIST + _OTSU + _HEAT + _CHANNELS, sql="final as (select 1) select img_id, " + ", ".join(f"cast(case when not by_heat then floor({c}_border) when n_back>10 then floor({c}_back) when is_dark then 0 else 255 end as bigint) pad_{c}" for c in "vgb") + " from hp join bc using (img_id) join bo using (img_id)")
def pad_colours(p):
    return raster.pad_colour(p.withColumns({"g": F.col("v") * 3 % 256, "b": 255 - F.col("v")}), ["v", "g", "b"])


@query("px", also=_HIST + _OTSU + _HEAT, sql="final as (select 1) select img_id%50 as block, img_id word, max((not by_heat)::int) over (partition by img_id%50 order by img_id rows unbounded preceding)=1 falls_back from hp")
def sticky_fallback(p):
    w = raster.heat_polarity(p).select((F.col("img_id") % 50).alias("block"), F.col("img_id").alias("word"), "by_heat")
    return raster.sticky_fallback(w).select("block", "word", "falls_back")


@query("px", sql="e as (select *, row_number() over (partition by img_id, floor(r/3), floor(c/3) order by r, c) k from px where v>=128) select img_id, cast(floor(r/3) as bigint) gr, cast(floor(c/3) as bigint) gc, r, c from e where k=1")
def thinned_points(p):
    return raster.thin_points(p.filter("v >= 128"), 3)


@query("px", sql="select img_id, r, c, round((v/255.0::double-0.485)/0.229,9) x0, round((v/255.0::double-0.456)/0.224,9) x1, round((v/255.0::double-0.406)/0.225,9) x2 from px")
def normalised_pixels(p):
    one = [F.round(raster.normalise(F.array("v"), m, s)[0], 9).alias(f"x{i}") for i, (m, s) in enumerate(((0.485, 0.229), (0.456, 0.224), (0.406, 0.225)))]
    return p.select("img_id", "r", "c", *one)


# -- components

_CLASSED = """valid as (select *, area>=600000*0.00003 ok from components), crank as (select *, row_number() over (partition by img_id order by ok desc, area desc, comp_id desc) rk from valid),
 med as (select img_id, quantile_cont(area,0.5) filter (where ok and rk<=10) ma from crank group by img_id), anch as (select c.*, ma, coalesce(ok and area>=0.2*ma, false) anchor from crank c join med using (img_id)),
 mh as (select img_id, quantile_cont(hgt,0.5) filter (where anchor) mh from anch group by img_id),
 dist as (select c.img_id, c.comp_id, sqrt(min(greatest(a.lft-(c.lft+floor(c.wid/2)),0,(c.lft+floor(c.wid/2))-(a.lft+a.wid))**2+greatest(a.tp-(c.tp+floor(c.hgt/2)),0,(c.tp+floor(c.hgt/2))-(a.tp+a.hgt))**2)) d from anch c join anch a on a.img_id=c.img_id and a.anchor where c.ok and not c.anchor and c.area>=0.01*c.ma group by c.img_id, c.comp_id),
 classed as (select a.img_id, a.comp_id, a.area, case when anchor then 'anchor' when d<=0.8*mh then 'near' else 'removed' end as class from anch a join mh using (img_id) left join dist on dist.img_id=a.img_id and dist.comp_id=a.comp_id), """


@query("components", also=_CLASSED, sql="final as (select 1) select img_id, comp_id, area, class from classed")
def component_classes(c):
    return components.classify(c, 600_000).select("img_id", "comp_id", "area", "class")


@query("components", also=_CLASSED, sql="final as (select 1) select img_id, count(*) filter (where class='anchor') n_anchor, count(*) filter (where class='near') n_near, count(*) filter (where class='removed') n_removed, round(100.0::double*sum(case when class in ('anchor','near') then area else 0 end)/sum(area),6) kept_area_pct from classed group by img_id")
def component_class_counts(c):
    return components.class_counts(components.classify(c, 600_000))


@query("components", sql="m as (select *, max(area) over (partition by img_id) mx from components) select img_id, comp_id, area from m where area>=greatest(5.0::double,least(50.0::double,mx*0.001::double))")
def speckle_filter(c):
    return components.speckle_filter(c).select("img_id", "comp_id", "area")


@query("components", sql="t as (select *, cast(row_number() over (partition by img_id order by area desc, comp_id desc) as bigint) rk from components) select img_id, comp_id, area, rk from t where rk<=10")
def top_component_areas(c):
    return components.top_areas(c).select("img_id", "comp_id", "area", F.col("rank").alias("rk"))


# -- report

_STRIPS = """strips as (select stem, block_id, coalesce(string_agg(trim(word_mat), ' ' order by printf('%s_word_%03d_strip.png', block_id, word_idx), trim(word_mat)) filter (where trim(word_mat)<>''),'') as text,
 coalesce(string_agg(trim(word_raw), ' ' order by printf('%s_word_%03d_strip.png', block_id, word_idx), trim(word_raw)) filter (where trim(word_raw)<>''),'') text_raw, count(*) n_words from ocr_words group by stem, block_id), """
_WITH_ERROR = "flagged as (select *, case when n_words%17=0 then 'failed' end error from strips), "


def _failing(words):
    return report.strip_texts(words).withColumn("error", F.when(F.col("n_words") % 17 == 0, "failed"))


@query("ocr_words", also=_STRIPS, sql="final as (select 1) select stem, block_id, text, text_raw, n_words from strips")
def strip_texts(w):
    return report.strip_texts(w)


@query("ocr_words", also=_STRIPS + _WITH_ERROR, sql="""final as (select 1) select stem, count(*) n_splits, count(*) filter (where error is null) n_texts, trim(coalesce(string_agg(text, ' ' order by block_id) filter (where error is null and text<>''),'')) predicted_text,
 string_agg(block_id||'_strip.png', ',' order by block_id) crop_images from flagged group by stem""")
def page_texts(w):
    p = report.page_texts(_failing(w))
    return p.select("stem", F.size("splits").cast("bigint").alias("n_splits"), F.size("texts").cast("bigint").alias("n_texts"), "predicted_text", F.array_join("crop_images", ",").alias("crop_images"))


@query("ocr_words", also=_STRIPS + _WITH_ERROR, sql="""final as (select 1) select stem, block_id strip_stem, case when error is null then 0.0::double else 100.0::double end cer, case when error is null then 0.0::double else 100.0::double end wer, error from flagged""")
def failed_strip_rates(w):
    s = report.summaries(report.page_texts(_failing(w)))
    return s.select("stem", F.explode("splits").alias("s")).select("stem", "s.strip_stem", "s.cer", "s.wer", "s.error")


def _artefacts(words):
    n = max(200, 4 * int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")))  # many, as a strip takes some bytes in a shuffle and hundreds when sorted with its artefacts
    strips = words.select("stem", "block_id", "word_idx").repartition(n, "stem").distinct().withColumn("name", F.format_string("%s_word_%03d_strip.png", "block_id", "word_idx"))
    path = lambda kind, name: F.struct(F.lit(kind).alias("kind"), name.alias("name"), F.concat_ws("/", F.lit(kind), F.col("stem"), name).alias("path"))
    made = F.array(
        F.when(F.col("word_idx") % 2 == 0, path("binarized", x.binarized_name(F.col("name")))), F.when(F.col("word_idx") % 3 == 0, path("original", x.original_name(F.col("name")))),
        F.when(F.col("word_idx") == 1, path("block", F.concat("block_id", F.lit("_block.png")))), F.when(F.col("block_id").startswith("title"), path("craft", F.concat("block_id", F.lit("_craft.png")))),
        F.when(F.col("word_idx") % 5 == 0, path("debug", F.concat(x.stem(F.col("name")), F.lit("_mat_debug.png")))), F.when(F.col("stem").endswith("7"), path("layout", F.lit("layout.png"))),
        F.when(F.col("stem").endswith("3"), path("page", F.concat("stem", F.lit(".jpg")))),
    )
    return strips.select("stem", "name"), strips.select("stem", F.explode(made).alias("a")).filter("a is not null").select("stem", "a.*")


@query("ocr_words", sql="""s as (select distinct stem, block_id, word_idx, printf('%s_word_%03d_strip.png', block_id, word_idx) as name from ocr_words), n as (select *, replace(name,'.png','') ns from s)
 select stem, name, case when word_idx%2=0 then 'binarized/'||stem||'/'||ns||'_binarized.png' else '' end binarized, case when word_idx%3=0 then 'original/'||stem||'/'||replace(name,'_strip.png','.png') else '' end original,
 'block/'||stem||'/'||block_id||'_block.png' as block, case when block_id like 'title%' then 'craft/'||stem||'/'||block_id||'_craft.png' else '' end craft, case when word_idx%5=0 then 'debug/'||stem||'/'||ns||'_mat_debug.png' else '' end debug,
 case when stem like '%7' then 'layout/'||stem||'/layout.png' else '' end page, case when stem like '%3' then 'page/'||stem||'/'||stem||'.jpg' else '' end page_image from n""")
def artefact_lookup(w):
    return report.attach_artefacts(*_artefacts(w))


@query("ocr_words", also=_STRIPS, sql="""done as (select stem, trim(coalesce(string_agg(text,' ' order by block_id) filter (where text<>''),'')) t from strips where stem not like '%3' group by stem), asked as (select distinct stem from strips)
 select stem, stem||'.jpg' fname, coalesce(t,'') predicted_text, case when t is null then 'No output generated' end error from asked left join done using (stem)""")
def collected_results(w):
    done = report.page_texts(_failing(w).withColumn("error", F.lit(None).cast("string"))).filter(~F.col("stem").endswith("3"))
    return report.collect_results(w.select(F.concat("stem", F.lit(".jpg")).alias("name")).distinct(), done)


@query("ocr_words", also=_STRIPS, sql="done as (select stem, trim(coalesce(string_agg(text,' ' order by block_id) filter (where text<>''),'')) t from strips where stem not like '%3' group by stem), asked as (select distinct stem from strips) select count(*) images, count(*) filter (where t is not null and t<>'') successful, count(*) filter (where t is null or t='') issues from asked left join done using (stem)")
def run_statistics(w):
    done = report.page_texts(_failing(w).withColumn("error", F.lit(None).cast("string"))).filter(~F.col("stem").endswith("3"))
    return report.run_statistics(report.collect_results(w.select(F.concat("stem", F.lit(".jpg")).alias("name")).distinct(), done))


@query("ocr_words", sql="a as (select distinct stem from ocr_words), b as (select distinct stem from ocr_words where stem not like '%3') select stem, '' predicted_text, 'No preprocessed strips found' error from a where stem not in (select stem from b)")
def pages_without_strips(w):
    return report.pages_without_strips(w.select("stem").distinct(), w.filter(~F.col("stem").endswith("3")))


@query("ocr_words", sql="""own as (select distinct stem, printf('%s_%s_%03d%s', stem, block_id, word_idx, case when word_idx%5=0 then '_binarized.png' else '.png' end) as name from ocr_words)
 select stem, name from own where name not like '%\\_binarized.png' escape '\\'""")
def strip_source(w):
    """Pages whose number ends in 7 have no folder of their own."""
    name = F.concat(F.format_string("%s_%s_%03d", "stem", "block_id", "word_idx"), F.when(F.col("word_idx") % 5 == 0, "_binarized.png").otherwise(".png"))
    own = w.select("stem", name.alias("name")).distinct()
    return report.strip_source(own.select("stem").distinct(), own.filter(~F.col("stem").endswith("7")), own.select("name")).distinct()


@query("samples", sql="""asked as (select sample_id ord, concat(cast(floor(sample_id/2)*3 as bigint),'.png') as name from samples) select ord, a.name as name from asked a join samples s on s.file_name=a.name""")
def requested_images(s):
    asked = s.select(F.col("sample_id").alias("ord"), F.concat((F.floor(F.col("sample_id") / 2) * 3).cast("string"), F.lit(".png")).alias("name"))
    return report.requested_images(s.select(F.col("file_name").alias("name")), asked).select("ord", "name")


@query("ocr_words", sql="""f as (select distinct stem, printf('%s_%03d', block_id, word_idx) base, word_idx%4 k from ocr_words), n as (select stem, base||case k when 0 then '_Edges_Stg5-Denoise.png' when 1 then '_Edges_Stg2-Blur.png' when 2 then '.PNG' else '.txt' end as name from f)
 select stem, name, name like '%.PNG' edge_input, name like '%Denoise.png' axis_input, replace(name,'_Edges_Stg5-Denoise.png','') axis_stem from n""")
def edge_stages(w):
    end = F.element_at(F.array(*map(F.lit, ("_Edges_Stg5-Denoise.png", "_Edges_Stg2-Blur.png", ".PNG", ".txt"))), (F.col("word_idx") % 4).cast("int") + 1)
    n = w.select("stem", F.concat(F.format_string("%s_%03d", "block_id", "word_idx"), end).alias("name")).distinct()
    return n.select("stem", "name", x.is_edge_input(F.col("name")).alias("edge_input"), x.is_axis_input(F.col("name")).alias("axis_input"), x.axis_stem(F.col("name")).alias("axis_stem"))


@query("detections", sql="select page_id, det_idx, label, score, x1, y1, x2, y2 from detections")
def exploded_detections(d):
    """Detections packed as a page's JSON array come out as they were."""
    box = F.struct("det_idx", F.struct("label", "score", F.array("x1", "y1", "x2", "y2").alias("coordinate")).alias("b"))
    packed = d.groupBy("page_id").agg(F.to_json(F.transform(F.array_sort(F.collect_list(box)), lambda e: e.b)).alias("boxes"))
    return regions.explode_detections(packed)


@query("samples", sql="select sample_id, concat(class_name,'/',file_name) rel, regexp_extract(class_name,'^([A-Za-z]+)_',1) category, regexp_extract(class_name,'^[A-Za-z]+_(.+)$',1) as label, printf('%04d', sample_id%10000) serial from samples")
def sample_names(s):
    mark = F.when(F.col("sample_id") % 2 == 0, "/").otherwise("\\")
    path = F.concat_ws("", F.lit("/data"), mark, F.lit("in"), mark, F.col("class_name"), mark, F.col("file_name"))
    category, label, serial = x.class_parts(F.concat("class_name", F.lit("_"), F.format_string("%04d", F.col("sample_id") % 10_000)))
    return s.select("sample_id", x.relative(path, "/data/in").alias("rel"), category.alias("category"), label.alias("label"), serial.alias("serial"))


@query("ocr_words", sql="""n as (select distinct stem, block_id, word_idx, printf('%s_%s_word_%03d%s', stem, block_id, word_idx, case word_idx%4 when 0 then '_binarized.png' when 1 then '_strip.PNG' when 2 then '_strip.png' else '.txt' end) as name from ocr_words)
 select stem, name, cast(row_number() over (partition by stem order by name) as bigint) as place from n where lower(regexp_extract(name,'.(\\.[^.]+)$',1)) in ('.png','.jpg','.jpeg') and not regexp_matches(name,'(_preMAT|_binarized|_mat_debug)\\.png$')""")
def strip_listing(w):
    end = F.element_at(F.array(F.lit("_binarized.png"), F.lit("_strip.PNG"), F.lit("_strip.png"), F.lit(".txt")), (F.col("word_idx") % 4).cast("int") + 1)
    n = w.select("stem", F.format_string("%s_%s_word_%03d%s", "stem", "block_id", "word_idx", end).alias("name")).distinct()
    return n.filter(x.is_strip_file(F.col("name"), F.col("stem"))).withColumn("place", F.row_number().over(Window.partitionBy("stem").orderBy("name")).cast("bigint"))


@query("ocr_words", sql="""s as (select distinct stem, block_id, word_idx, printf('%s_word_%03d_strip.png', block_id, word_idx) as name from ocr_words)
 select stem, name, replace(name,'.png','') file_stem, '.png' ext, block_id block, replace(name,'.png','')||'_binarized.png' binarized, replace(name,'_strip.png','.png') original, 'orig_'||name orig from s""")
def path_algebra(w):
    s = w.select("stem", F.format_string("%s_word_%03d_strip.png", "block_id", "word_idx").alias("name")).distinct()
    n = F.col("name")
    return s.select("stem", "name", x.stem(n).alias("file_stem"), x.ext(n).alias("ext"), x.block_of(n).alias("block"), x.binarized_name(n).alias("binarized"), x.original_name(n).alias("original"), F.concat(F.lit("orig_"), n).alias("orig"))


@query("ocr_words", also=_STRIPS, sql="final as (select 1) select stem, block_id, substring(text,1,60) preview from strips")
def text_previews(w):
    return report.strip_texts(w).select("stem", "block_id", x.preview(F.col("text")).alias("preview"))


@query("documents", sql="""w as (select doc_id, string_split(text,' ') w from documents) select doc_id, case when len(w)>6 then len(list_distinct(list_transform(range(1,len(w)-4), lambda i: array_to_string(w[i:i+5],' '))))<len(w)-5 else false end repeated from w""")
def repeated_6grams(d):
    return d.select("doc_id", x.repeats_ngram(F.col("text")).alias("repeated"))


# -- jobs


@query("job_events", sql="select job_id, arg_max(status, {'a': ts, 'b': seq_id}) status, count(*) n_log from job_events group by job_id")
def job_status(e):
    return report.job_status(e)


@query("job_events", sql="t as (select *, coalesce(max((status in ('done','failed'))::int) over (partition by job_id order by ts, seq_id rows between unbounded preceding and 1 preceding),0) over_ from job_events) select job_id, seq_id, status from t where over_=0")
def job_until_terminal(e):
    return report.until_terminal(e).select("job_id", "seq_id", "status")


@query("job_events", sql="t as (select *, cast(row_number() over (partition by job_id order by ts, seq_id) as bigint) line_no from job_events) select job_id, seq_id, line_no, msg from t where line_no>5")
def job_log_tail(e):
    return report.log_tail(e, 5).select("job_id", "seq_id", "line_no", "msg")


# -- recogniser quality


_RATE = "round(sum(levenshtein(truth,{0}))/nullif(sum(length(truth)),0)::double,9) cer_{0}"


@query("ocr_pairs", sql=f"select doc_id, {_RATE.format('mat')}, {_RATE.format('raw')} from ocr_pairs group by doc_id")
def character_error_rates(p):
    return quality.error_rates(p)


@query("ocr_pairs", sql=f"select source, {_RATE.format('mat')}, {_RATE.format('raw')}, count(*) n from ocr_pairs group by source")
def pooled_error_rates(p):
    return quality.pooled_error_rates(p)


@query("ocr_pairs")
def edit_operations(p):
    """No SQL: a shortest script is not unique. The tests replay scripts and compare their length with a plain matrix."""
    return quality.operation_counts(p)


@query("ocr_strips", sql="""d as (select *, levenshtein(truth,mat) m, levenshtein(truth,raw) r, levenshtein(mat,raw) b from ocr_strips)
 select source, round(avg((mat=raw)::int),9) equal_rate, round(avg(b),9) mean_distance, count(*) filter (where m<r) mat_nearer, count(*) filter (where m>r) raw_nearer, count(*) filter (where m=r) ties from d group by source""")
def recogniser_agreement(s):
    return quality.agreement(s)


@query("ocr_pairs")
def word_error_rates(p):
    """No SQL: there is no edit distance of lists. The tests compare with a plain matrix."""
    return quality.word_error_rates(p)


# -- training data

_SPLIT = """cc as (select class_name, count(*) n, sum(count(*)) over () total from samples group by class_name), ex as (select *, n*ceil(total*0.2::double)/total exact from cc), bs as (select *, floor(exact) base from ex),
 qt as (select class_name, base+(row_number() over (order by round(exact-base,9) desc, class_name)<=ceil(total*0.2::double)-sum(base) over ())::int n_val from bs),
 parts as (select s.*, case when row_number() over (partition by s.class_name order by md5(cast(sample_id as varchar)), sample_id)<=n_val then 'val' else 'train' end split from samples s join qt using (class_name)), """


@query("samples", also=_SPLIT, sql="final as (select 1) select sample_id, class_name, split from parts")
def stratified_split(s):
    return training.stratified_split(s).select("sample_id", "class_name", "split")


@query("samples", sql="select sample_id, class_name, cast(dense_rank() over (order by class_name)-1 as bigint) class_idx from samples")
def class_indices(s):
    return training.class_indices(s).select("sample_id", "class_name", "class_idx")


@query("samples", sql="c as (select distinct class_name from samples) select cast(row_number() over (order by class_name)-1 as int) class_idx, class_name folder from c")
def class_map(s):
    """The class map as one JSON object, and read back from it."""
    classes = training.class_indices(s.select("class_name").distinct()).select("class_idx", F.col("class_name").alias("folder"))
    return files.parsed_class_map(files.class_map_json(classes), "json")


@query("samples", sql="t as (select * from samples order by md5(file_name||'42'), file_name limit 9) select sample_id, file_name from t")
def sample_images(s):
    return training.sample_images(s).select("sample_id", "file_name")


@query("samples", sql="a as (select *, 'test' source, 0 source_order from samples where class_name like 'en%' order by file_name limit 1000), b as (select *, 'train' source, 1 source_order from samples where class_name not like 'en%' order by file_name limit 9000) select sample_id, file_name, source, source_order from a union all select sample_id, file_name, source, source_order from b")
def first_per_source(s):
    return training.first_per_source(s, {"test": 1000, "train": 9000}, F.when(F.col("class_name").startswith("en"), "test").otherwise("train")).select("sample_id", "file_name", "source", "source_order")


@query("samples", "documents", sql="select sample_id, file_name, length(text) n from samples join documents on doc_id=sample_id")
def labelled_images(s, d):
    truth = d.select(F.format_string("%d.jpg", "doc_id").alias("file_name"), "text")
    made = training.match_labels(s.select(F.col("file_name").alias("name"), "sample_id"), truth)
    return made.select("sample_id", F.col("name").alias("file_name"), F.length("text").cast("bigint").alias("n"))


@query("samples", sql="select class_name, min(sample_id) sample_id, count(*) n from samples group by class_name")
def first_uploads(s):
    u = report.first_uploads(s.select(F.col("class_name").alias("name"), F.col("sample_id").alias("seq")))
    return u.join(s.groupBy(F.col("class_name").alias("name")).agg(F.count("*").alias("n")), "name").select(F.col("name").alias("class_name"), F.col("seq").alias("sample_id"), "n")


@query("samples", sql="f as (select sample_id, case sample_id%3 when 0 then 'punct_exclaim_0305' when 1 then 'punct_slash_0307' else class_name end class_name from samples), r as (select sample_id, case class_name when 'punct_exclaim_0305' then 'punct_!_0305' when 'punct_slash_0307' then 'punct_/_0307' else class_name end folder from f) select sample_id, folder, case folder when 'punct_!_0305' then 0 else 1 end class_idx from r where folder like 'punct%'")
def remapped_classes(s):
    own = F.element_at(F.array(F.lit("punct_exclaim_0305"), F.lit("punct_slash_0307"), F.col("class_name")), (F.col("sample_id") % 3).cast("int") + 1)
    classes = s.sparkSession.createDataFrame([(0, "punct_!_0305"), (1, "punct_/_0307")], "class_idx int, folder string")
    return training.remapped_classes(s.select("sample_id", own.alias("class_name")), classes).select("sample_id", "folder", "class_idx")


@query("samples", sql="c as (select split_part(class_name,'_',1) as category, split_part(class_name,'_',2) as label, printf('%04d', sample_id%97) serial from samples), a as (select 'serial' kind, serial as key, count(distinct label) n from c group by serial union all select 'label', label, count(distinct serial) from c group by label) select kind, key, n from a where n>1")
def class_audit(s):
    p = F.split("class_name", "_")
    return training.class_audit(s.select(p[0].alias("category"), p[1].alias("label"), F.format_string("%04d", F.col("sample_id") % 97).alias("serial")))


_HISTORY = """h as (select epoch, round(sum(loss*n) filter (where phase='train')/sum(n) filter (where phase='train'),6) train_loss, round(sum(loss*n) filter (where phase='val')/sum(n) filter (where phase='val'),6) val_loss,
 round(sum(correct) filter (where phase='train')/(sum(n) filter (where phase='train'))::double,6) train_acc, round(sum(correct) filter (where phase='val')/(sum(n) filter (where phase='val'))::double,6) val_acc from batch_log group by epoch), """
_STOP = """w as (select *, coalesce(val_loss<min(val_loss) over (order by epoch rows between unbounded preceding and 1 preceding), true) is_best from h),
 b as (select *, last_value(case when is_best then epoch end ignore nulls) over (order by epoch rows unbounded preceding) best_epoch from w), s as (select *, epoch-best_epoch waited from b),
 e as (select * from s where epoch<=coalesce((select min(epoch) from s where waited>=5), 1000000)), """


@query("batch_log", also=_HISTORY, sql="final as (select 1) select * from h")
def epoch_metrics(b):
    return training.epoch_metrics(b)


@query("batch_log", also=_HISTORY + _STOP, sql="final as (select 1) select epoch, val_loss, is_best, best_epoch, waited from e")
def early_stop_replay(b):
    return training.replay_early_stop(training.epoch_metrics(b)).select("epoch", "val_loss", "is_best", "best_epoch", "waited")


@query("batch_log", also=_HISTORY + _STOP, sql="k as (select * from e order by val_loss, epoch limit 1) select k.epoch best_epoch, round(k.val_loss,6) best_val_loss, round(k.val_acc*100,2) best_val_acc_pct, (select count(*) from e) epochs_ran, (select max(waited)>=5 from e) early_stopped from k")
def training_summary(b):
    return training.training_summary(training.epoch_metrics(b))


@query("batch_log", sql="""t as (select epoch, sum(n) secs from batch_log group by epoch), a as (select epoch, avg(secs) over (order by epoch rows between 4 preceding and current row) avg_s from t),
 l as (select *, cast(floor(round(avg_s*(20-epoch),6)) as bigint) s from a) select epoch, round(avg_s,6) avg_s, case when s<0 then 'calculating...' when s>=3600 then printf('%dh %02dm %02ds', s//3600, s%3600//60, s%60) when s>=60 then printf('%dm %02ds', s//60, s%60) else printf('%ds', s) end eta from l""")
def epoch_eta(b):
    return training.epoch_eta(b.groupBy("epoch").agg(F.sum("n").alias("seconds")))


@query("batch_log", sql="t as (select distinct epoch from batch_log) select epoch, round(1e-6+(1e-4-1e-6)*(1+cos(pi()*(epoch-1)/20))/2,12) lr from t")
def cosine_rates(b):
    return b.select("epoch").distinct().select("epoch", F.round(training.cosine_rate(F.col("epoch") - 1), 12).alias("lr"))


@query("embeddings", sql="""l as (select vec_id, label, list_transform(embedding, lambda v: v::double) z from embeddings), s as (select *, ln(list_sum(list_transform(z, lambda v: exp(v)))) lse from l)
 select vec_id, round(0.92*(lse-z[label+1])+0.08*(lse-list_sum(z)/len(z)),6) loss from s""")
def smoothed_losses(e):
    return e.select("vec_id", F.round(training.smoothed_loss(F.col("embedding"), F.col("label")), 6).alias("loss"))


_MODEL = """sm as (select vec_id sample_id, cast(label as varchar) class_name, label, embedding from embeddings), samples as (select sample_id, class_name from sm), """
_NEAREST = """tr as (select e.*, split from sm e join parts using (sample_id)), dims as (select label, i, avg(embedding[i]::double) m from tr, range(1,65) t(i) where split='train' group by label, i),
 cen as (select label, list(m order by i) ms from dims group by label),
 nn as (select v.sample_id vec_id, v.label, c.label pred, row_number() over (partition by v.sample_id order by round(list_sum(list_transform(range(1,65), lambda i: (v.embedding[i]::double-c.ms[i])*(v.embedding[i]::double-c.ms[i]))),9), c.label) k from tr v, cen c where v.split='val'), """


def _split_vectors(e):
    parts = training.stratified_split(e.select(F.col("vec_id").alias("sample_id"), F.col("label").cast("string").alias("class_name")))
    return e.join(parts.select(F.col("sample_id").alias("vec_id"), "split"), "vec_id")


def _predicted(e):
    v = _split_vectors(e)
    return training.nearest_centroid(v.filter("split = 'val'"), training.centroids(v.filter("split = 'train'")))


@query("embeddings", also=_MODEL + _SPLIT + _NEAREST, sql="final as (select 1) select vec_id, label, pred from nn where k=1")
def nearest_centroids(e):
    return _predicted(e).select("vec_id", "label", "pred")


@query("embeddings", also=_MODEL + _SPLIT + _NEAREST, sql="final as (select 1) select label, pred, count(*) n from nn where k=1 group by label, pred")
def confusion_matrix(e):
    return training.confusion(_predicted(e))


@query("embeddings", also=_MODEL + _SPLIT + _NEAREST, sql="final as (select 1) select count(*) n, round(avg((label=pred)::int),9) accuracy from nn where k=1")
def validation_accuracy(e):
    return training.accuracy(_predicted(e))


@query("embeddings")
def logistic_regression(e):
    return training.logistic_regression(_split_vectors(e))


@query("embeddings", also=_MODEL + _SPLIT + _NEAREST, sql="final as (select 1) select vec_id, label, pred, cast(null as varchar) error from nn where k=1")
def scored_partitions(e, most_cells: int = 2_000_000):
    """The centroids as a user's model, held by the workers in blocks of classes of about so many numbers; one block does for some ten thousand classes."""
    import numpy as np
    import pandas as pd

    v = _split_vectors(e)
    model = training.centroids(v.filter("split = 'train'")).persist()
    blocks = 1 + model.count() // most_cells
    asked = v.filter("split = 'val'").select("vec_id", "label", "embedding")

    def predict(model, batch):
        own, centres = model
        z = np.stack([np.asarray(a, dtype=np.float64) for a in batch["embedding"]])
        away = np.round(((z[:, None, :] - centres[None]) ** 2).sum(-1), 9)
        best = away.argmin(1)
        return pd.Series([{"d": float(away[i, k]), "pred": own[k]} for i, k in enumerate(best)], index=batch.index)

    def scored(k: int):
        rows = model.filter(F.pmod(F.hash("label"), F.lit(blocks)) == k).groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "mean"))), lambda d: d.mean).alias("mean")).orderBy("label").collect()  # a row a class of the block
        if not rows:
            return None
        held = [r.label for r in rows], np.array([r["mean"] for r in rows], dtype=np.float64)
        return models.score_partitions(asked, lambda: held, predict, "best struct<d:double,pred:int>", f"centroids-{abs(hash(held[1].tobytes()))}")

    parts = [p for p in map(scored, range(blocks)) if p is not None]
    if len(parts) == 1:
        return parts[0].select("vec_id", "label", F.col("best.pred").alias("pred"), "error")
    return reduce(DataFrame.unionByName, parts).groupBy("vec_id", "label").agg(F.min("best").alias("best"), F.max("error").alias("error")).select("vec_id", "label", F.col("best.pred").alias("pred"), "error")
