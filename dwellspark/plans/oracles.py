"""The registered queries in SQL, for a check on another engine over the same tables."""

from __future__ import annotations

from dwellspark.plans.tables import FORM_COLUMNS, LISTING_COLUMNS, RAW_COLUMNS, REQUEST_COLUMNS

PARTS = "from (select p.*, d.text from part p join documents d on d.doc_id = p.p_partkey % (select count(*) from documents))"
LISTING = f"listing as (select {LISTING_COLUMNS} {PARTS})"
RAW = f"raw as (select {RAW_COLUMNS} {PARTS})"
FORM = f"form as (select {FORM_COLUMNS} from part)"
N = "(select count(*) from embeddings)"
HALF = "(select count(*)//2 from listing)"
INDEX = f"""{LISTING}, idx as (
  select l.*, s.embedding::double[] as sv, d.embedding::double[] as dv
  from listing l join embeddings s on s.vec_id = l.id % {N}
  join embeddings d on d.vec_id = (l.id + {N}//2) % {N})"""
REQUEST = f"request as (select r.*, e.embedding::double[] as qv from (select {REQUEST_COLUMNS} from listing) r join benchmark on item_id = r.query_id join embeddings e on e.vec_id = r.query_id % {N})"
MEAN = """mean as (select list(x order by i) as qv from (select i, avg(x) as x from (
  select generate_subscripts(embedding, 1) as i, unnest(embedding)::double as x from embeddings) group by i))"""
EACH = f"q as (select item_id as query_id, embedding::double[] as qv from benchmark join embeddings on vec_id = item_id % {N})"


def cos(a: str, b: str) -> str:
    return f"round(list_cosine_similarity({a}, {b}), 9)"


def top(score: str, items: str, k: int, name: str = "hit", condition: str = "true") -> str:
    return f"""{name} as (select query_id, rank, id, score from (
  select query_id, id, score, row_number() over (partition by query_id order by score desc, id) as rank
  from (select query_id, id, {score} as score from q, {items} where {condition})) where rank <= {k})"""


MAX_SIM = f"greatest({cos('qv', 'sv')}, {cos('qv', 'dv')})"
FILTER_ALL = """price between 905 and 1900 and rooms between 0.5 and 4.0 and not has_parking and has_elevator
  and not coalesce(furnished, false)"""

SPACE = r"'\s+'"
DECODED = (
    """regexp_replace(replace(regexp_replace(regexp_replace({0}, '&quot;?', '"', 'g'), '&copy;?', '©', 'g'),"""
    """ '&middot;', '·'), '&amp;?', '&', 'g')"""
)
COLLAPSED = "regexp_replace({0}, " + SPACE + ", ' ', 'g')"


def clean(column: str) -> str:
    return f"trim({COLLAPSED.format(DECODED.format(column))})"


def clean_column(column: str) -> str:
    return f"case when {column} <> '' then {clean(column)} else {column} end as {column}"


BARE_PRICE = "trim(replace(replace(price, ',', ''), 'ש״ח', ''))"
CLEANED = f"""cleaned as (select external_id, {clean_column('title')}, {clean_column('description')}, {clean_column('location')},
  {clean_column('neighborhood')}, {clean_column('city')},
  case when regexp_full_match({BARE_PRICE}, '[+-]?[0-9]+') then cast({BARE_PRICE} as int) end as price,
  case when regexp_full_match(trim(rooms), '[0-9]+[.]?[0-9]*') then cast(trim(rooms) as double) end as rooms,
  case when regexp_full_match(trim(size_sqm), '[0-9]+') then cast(trim(size_sqm) as int) end as size_sqm,
  cast(floor as int) as floor, cast(total_floors as int) as total_floors,
  coalesce(length(has_parking) > 0, false) as has_parking, coalesce(length(has_elevator) > 0, false) as has_elevator,
  coalesce(length(has_balcony) > 0, false) as has_balcony, coalesce(length(has_storage) > 0, false) as has_storage,
  coalesce(length(furnished) > 0, false) as furnished, pets_allowed from raw)"""
GOOD = "good as (select * from cleaned where rooms is null or rooms < 99.95)"
REASON = "case when rooms >= 99.95 then 'rooms out of range' else '' end"

ROOMS_TEXT = r"regexp_replace(cast(rooms as varchar), '\.0$', '')"


SENTENCE = f"""concat_ws(', ', {ROOMS_TEXT}||' חדרים', nullif(city, ''),
  coalesce(nullif(neighborhood, ''), nullif(location, '')),
  case when has_parking then 'עם חניה' end, case when has_elevator then 'עם מעלית' end,
  case when furnished then 'מרוהט' end, case when has_balcony then 'עם מרפסת' end,
  case when has_storage then 'עם מחסן' end, format('{{:,}}', price)||' ש״ח',
  case when size_sqm <> 0 then size_sqm||' מ״ר' end,
  case when floor = 0 then 'קרקע' when floor < 0 then 'קומה '||abs(floor)||' למטה' else 'קומה '||floor end)"""
CARD_FLAGS = """case when has_parking then '🚗 חניה' end, case when has_elevator then '🛗 מעלית' end,
  case when has_balcony then '🌳 מרפסת' end, case when has_storage then '📦 מחסן' end,
  case when furnished then '🛋️ מרוהט' end, case when pets_allowed then '🐾 חיות מחמד' end"""

FLAGS = ["has_parking", "has_elevator", "has_balcony", "has_storage", "furnished"]
PAYLOAD = f"""id as listing_id, external_id, price, rooms, size_sqm, floor, total_floors, nullif(city, '') as city,
  nullif(location, '') as location, nullif(neighborhood, '') as neighborhood,
  {', '.join(f'coalesce({f}, false) as {f}' for f in FLAGS)}, pets_allowed"""
JSON_PARTS = ", ".join(
    [f"'\"{n}\":'||{n}" for n in ("listing_id", "price", "rooms", "size_sqm", "floor", "total_floors")]
    + [f"'\"{n}\":\"'||{n}||'\"'" for n in ("city", "location", "neighborhood")]
    + [f"'\"{n}\":'||{n}" for n in [*FLAGS, "pets_allowed"]]
).replace("'\"price\"", "'\"external_id\":\"'||external_id||'\"', '\"price\"", 1)


def buckets(source: str, key: str, text: str, dim: int, name: str) -> str:
    """Sparse token counts and the dense unit vector of each text, at storage precision."""
    return f"""{name}_count as (select {key} as k, b, count(*) as c from (
    select {key}, cast('0x'||substr(md5(t), 1, 8) as bigint) % {dim} as b
    from (select {key}, unnest(regexp_split_to_array(lower({text}), {SPACE})) as t from {source}) where t <> '')
    group by 1, 2),
  {name}_norm as (select k, sqrt(sum(c*c)) as n from {name}_count group by k),
  {name}_cell as (select k, b, coalesce(c, 0)/n as w from (select k, n, unnest(range({dim})) as b from {name}_norm)
    left join {name}_count using (k, b)),
  {name} as (select k, list(cast(cast(w as float) as double) order by b) as v from {name}_cell group by k)"""


def best_per_model(dim: int) -> str:
    return f"""with {buckets('documents', 'doc_id', 'text', dim, 'item')}, {buckets('benchmark', 'item_id', 'text', dim, 'ask')}
  select 'hashing-{dim}' as model, {dim} as dimension, ask.k as query_id, max({cos('ask.v', 'item.v')}) as score
  from ask, item group by ask.k"""


def digest(vector: str) -> str:
    """One number of all values of a vector and their places."""
    return f"round(list_sum(list_transform({vector}, lambda x, i: round(x, 6) * i)), 6)"


BATCH = f"batch as (select 'ext-'||(id+{HALF}) as external_id, title, price+1000 as price, rooms, furnished from listing)"
COMPARED = f"""{INDEX}, {EACH}, {top(cos('qv', 'dv'), 'idx', 5, 'regular')}, {top(MAX_SIM, 'idx', 5, 'multi')},
  a as (select query_id, list(id order by rank) as ids, max(score) as s from regular group by query_id),
  b as (select query_id, list(id order by rank) as ids, max(score) as s from multi group by query_id),
  compared as (select query_id, array_to_string(a.ids, ',') as regular_top_ids, array_to_string(b.ids, ',') as multivector_top_ids,
    len(list_intersect(a.ids, b.ids)) as overlap_count, len(list_intersect(a.ids, b.ids))/5.0::double as overlap_ratio,
    a.ids[1] <> b.ids[1] as top_changed, a.s as regular_top_score, b.s as multivector_top_score,
    round(b.s - a.s, 9) as score_improvement, a.ids[:3] as a3, b.ids[:3] as b3
    from a join b using (query_id))"""

LISTING_FIELDS = """id, external_id, title, description, price, nullif(rooms, 0) as rooms, size_sqm, location, city, neighborhood,
  floor, total_floors, has_parking, has_elevator, has_balcony, has_storage, furnished, pets_allowed"""
CREATED_TEXT = "'2024-01-01T00:00:00+00:00'"
INGESTED = f"""{RAW}, {CLEANED}, {GOOD}, stored as (
  select *, row_number() over (order by external_id) as id from good)"""
STORED_TEXT = f"(select id, {SENTENCE} as text, description from stored)"
SENTENCES = f"{buckets(STORED_TEXT, 'id', 'text', 64, 'sv')}, {buckets('stored', 'id', 'description', 64, 'dv')}"
HITS = "found as (select label as query_id, vec_id as id, round(embedding[1]::double, 6) as score from embeddings)"

FITS = """(r.price_min is null or i.price >= r.price_min) and (r.price_max is null or i.price <= r.price_max)
  and (r.rooms_min is null or i.rooms >= r.rooms_min) and (r.rooms_max is null or i.rooms <= r.rooms_max)
  and (coalesce(r.city, '') = '' or i.city = r.city) and (coalesce(r.location, '') = '' or i.location = r.location)
  and (r.has_parking is null or coalesce(i.has_parking, false) = r.has_parking)
  and (r.has_elevator is null or coalesce(i.has_elevator, false) = r.has_elevator)
  and (r.furnished is null or coalesce(i.furnished, false) = r.furnished)"""
SEARCHED = f"""{INDEX}, {REQUEST}, scored as (
  select r.query_id, r."limit" as most, i.id, {MAX_SIM} as score, i.title, i.price, i.rooms from request r join idx i on
  {FITS}),
  ranked as (select *, row_number() over (partition by query_id order by score desc, id) as rank from scored)"""

MATCHED = f"""{LISTING}, request as (select {REQUEST_COLUMNS} from listing where id % 50 = 0),
  matched as (select r.query_id, i.* from request r join listing i on {FITS})"""
FACETS = ["city", "rooms", "has_parking", "has_elevator", "furnished"]
FACET_VALUE = " ".join(f"when grouping({c}) = 0 then {c}::varchar" for c in FACETS)
KEYWORDS = r"""posting as materialized (select id, token, count(*) as tf from (
    select id, unnest(regexp_split_to_array(lower(coalesce(title, '') || ' ' || coalesce(description, '')), '[^\p{L}\p{N}]+')) as token from listing)
    where token <> '' group by 1, 2),
  size as (select id, sum(tf) as length from posting group by id), whole as (select count(*) as n, avg(length) as mean from size),
  frequency as (select token, count(*) as df from posting group by token),
  asked as (select distinct item_id as query_id, token from (
    select item_id, unnest(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+')) as token from benchmark) where token <> ''),
  scored as (select query_id, id, round(sum(ln(1 + (n - df + 0.5::double) / (df + 0.5::double)) * tf * 2.2::double
      / (tf + 1.2::double * (0.25::double + 0.75::double * length / mean))), 6) as score
    from asked join posting using (token) join frequency using (token) join size using (id), whole group by 1, 2)"""

ORACLES = {
    "knn_top10": f"""with {MEAN} select vec_id as id, {cos('qv', 'embedding::double[]')} as score from embeddings, mean
  order by score desc, id limit 10""",
    "knn_batch": f"""with {EACH}, item as (select vec_id as id, embedding::double[] as v from embeddings),
  {top(cos('qv', 'v'), 'item', 10)} select * from hit""",
    "knn_many_queries": f"""with {EACH}, item as (select vec_id as id, embedding::double[] as v from embeddings),
  {top(cos('qv', 'v'), 'item', 10)} select * from hit""",
    "knn_filtered": f"""with {INDEX}, {MEAN} select id, {cos('qv', 'sv')} as score from idx, mean where {FILTER_ALL}
  order by score desc, id limit 20""",
    "rank_all": f"""with {MEAN}, s as (select vec_id as id, {cos('qv', 'embedding::double[]')} as score from embeddings, mean)
  select id, score, row_number() over (order by score desc, id) as rank from s""",
    "cosine_similarity": f"with {INDEX} select id, {cos('sv', 'dv')} as score from idx",
    "max_sim_top10": f"with {INDEX}, {MEAN} select id, {MAX_SIM} as score from idx, mean order by score desc, id limit 10",
    "max_sim_batch": f"with {INDEX}, {EACH}, {top(MAX_SIM, 'idx', 10)} select * from hit",
    "fuse_max_sim_top10": f"""with {INDEX}, {EACH}, {top(cos('qv', 'sv'), 'idx', 20, 'one')}, {top(cos('qv', 'dv'), 'idx', 20, 'two')},
  best as (select query_id, id, max(score) as score from (select * from one union all select * from two) group by 1, 2)
  select * from (select query_id, id, score, row_number() over (partition by query_id order by score desc, id) as rank from best)
  where rank <= 10""",
    "fuse_with_limits": f"""with {INDEX}, {EACH}, {top(MAX_SIM, 'idx', 100)} select * from hit
  where rank <= case when query_id % 3 > 0 then 1 + query_id % 30 else 10 end""",
    "filter_price": f"with {LISTING} select id, price from listing where price >= 905 and price <= 990",
    "filter_rooms": f"with {LISTING} select id, rooms from listing where rooms >= 1 and rooms <= 3.5",
    "filter_city": f"with {LISTING} select id, city from listing where city = 'Brand#17'",
    "filter_location": f"with {LISTING} select id, location from listing where location = 'ECONOMY'",
    "filter_flags": f"""with {LISTING} select id, has_parking, has_elevator, furnished from listing
  where has_parking and not has_elevator and not coalesce(furnished, false)""",
    "filter_all": f"with {LISTING} select id, price, rooms from listing where {FILTER_ALL}",
    "filter_inverted": f"with {LISTING} select id, price from listing where price >= 990 and price <= 905",
    "validate_requests": f"""with {FORM} select query_id, coalesce("limit", 10) as "limit",
  case when coalesce(trim(query), '') = '' then 'query is empty'
    when coalesce("limit", 10) not between 1 and 100 then 'limit out of range'
    when price_min < 0 then 'price_min is negative' when price_max < 0 then 'price_max is negative'
    when rooms_min < 0 then 'rooms_min is negative' when rooms_max < 0 then 'rooms_max is negative' else '' end as reason
  from form""",
    "normalize_ui_filters": f"""with {FORM} select query_id, greatest(1, least(50, coalesce("limit", 10))) as "limit",
  case when price_min > 0 then price_min end as price_min, case when price_max > 0 then price_max end as price_max,
  case when rooms_min > 0 then rooms_min end as rooms_min, case when rooms_max > 0 then rooms_max end as rooms_max,
  nullif(trim(city), '') as city, nullif(trim(location), '') as location from form""",
    "match_requests": f"with {MATCHED} select query_id, id, price, city from matched",
    "request_facets": f"""with {MATCHED} select query_id,
  case {' '.join(f"when grouping({c}) = 0 then '{c}'" for c in FACETS)} else 'total' end as facet,
  case {FACET_VALUE} end as value, count(*) as matches
  from matched group by grouping sets ({', '.join(f'(query_id, {c})' for c in FACETS)}, (query_id))""",
    "keyword_match": f"""with {LISTING}, {KEYWORDS}, ranked as (
    select *, row_number() over (partition by query_id order by score desc, id) as rank from scored)
  select query_id, rank, id, score from ranked where rank <= 10""",
    "search_filtered": f"""with {SEARCHED}
  select query_id, rank, score, count(*) over (partition by query_id) as total_results, id, title, price, rooms
  from ranked where rank <= most""",
    "search_stored": f"""with {SEARCHED}
  select query_id, rank, score, count(*) over (partition by query_id) as total_results, l.* replace (l.rooms as rooms),
  '2024-01-01 00:00:00' as created_at, '2024-01-01 00:00:00' as updated_at, '2024-01-01 00:00:00' as scraped_at
  from ranked join listing l using (id) where rank <= most""",
    "search_one": f"""with {LISTING}, sentence as (select id, {SENTENCE} as text from listing),
  ask_text as (select 1 as query_id, 'large green room' as query),
  {buckets('sentence', 'id', 'text', 64, 'sv')}, {buckets('listing', 'id', 'description', 64, 'dv')},
  {buckets('ask_text', 'query_id', 'query', 64, 'qv')},
  scored as (select l.id, greatest({cos('qv.v', 'sv.v')}, {cos('qv.v', 'dv.v')}) as score, l.title
    from qv, listing l join sv on sv.k = l.id left join dv on dv.k = l.id where l.price <= 1900 and l.has_parking),
  ranked as (select *, row_number() over (order by score desc, id) as rank from scored)
  select rank, score, (select least(20, count(*)) from scored) as total_results, id, title from ranked where rank <= 20""",
    "search_listings": f"with {SEARCHED} select query_id, rank, id, score from ranked where rank <= most",
    "search_text": f"""with {LISTING}, sentence as (select id, {SENTENCE} as text from listing),
  ask_text as (select p_name as query, min(p_partkey) as query_id from part group by 1),
  {buckets('sentence', 'id', 'text', 64, 'sv')}, {buckets('listing', 'id', 'description', 64, 'dv')},
  {buckets('ask_text', 'query_id', 'query', 64, 'qv')},
  scored as (select qv.k as query_id, l.id, greatest({cos('qv.v', 'sv.v')}, {cos('qv.v', 'dv.v')}) as score, l.title, l.price
    from qv, listing l join sv on sv.k = l.id left join dv on dv.k = l.id where l.price >= 910 and l.has_elevator),
  ranked as (select *, row_number() over (partition by query_id order by score desc, id) as rank from scored)
  select query_id, rank, score, id, title, price from ranked where rank <= 5""",
    "fetch_by_ids": f"""with {LISTING}, {HITS}
  select query_id, id, score, title, price, city from found join listing using (id)""",
    "fetch_page": f"""with {INDEX}, {MEAN}, best as (select id from idx, mean order by {MAX_SIM} desc, id limit 10)
  select id, title, price from best join listing using (id)""",
    "assign_rank": f"""with {LISTING}, {HITS}, best as (select * from (
    select *, row_number() over (partition by query_id order by score desc, id) as place from found) where place <= 50)
  select query_id, row_number() over (partition by query_id order by score desc, id) as rank, score,
  count(*) over (partition by query_id) as total_results, id, external_id from best join listing using (id)""",
    "text_preview": f"""with {LISTING}, {HITS}
  select query_id, id, substr(description, 1, 60)||'...' as preview from found join listing using (id)""",
    "html_unescape_pages": f"select page_id, {DECODED.format('html')} as html from pages",
    "collapse_whitespace_documents": f"select doc_id, {COLLAPSED.format('text')} as text from documents",
    "trim_text": f"with {RAW} select external_id, trim(title) as title from raw",
    "clean_text_documents": f"select doc_id, {clean('text')} as text from documents",
    "clean_text_pages": f"select page_id, {clean('html')} as html from pages",
    "clean_text_columns": f"with {RAW}, {CLEANED} select external_id, title, description, location, neighborhood, city from cleaned",
    "clean_numbers": f"with {RAW}, {CLEANED} select external_id, price, rooms, size_sqm from cleaned",
    "clean_flags": f"with {RAW}, {CLEANED} select external_id, {', '.join(FLAGS)}, pets_allowed from cleaned",
    "clean_listings": f"""with {RAW}, {CLEANED} select external_id, title, description, price, size_sqm, city, floor, has_parking,
  cast(pets_allowed as boolean) as pets_allowed, case when rooms < 99.95 then round(rooms, 1) end as rooms, {REASON} as reason from cleaned""",
    "structured_text": f"with {LISTING} select id, {SENTENCE} as structured_text from listing",
    "payload": f"with {LISTING} select {PAYLOAD} from listing",
    "payload_json": f"""with {LISTING}, p as (select {PAYLOAD} from listing)
  select listing_id as id, '{{'||concat_ws(',', {JSON_PARTS})||'}}' as payload from p""",
    "build_points": f"""with {LISTING}, sentence as (select id, {SENTENCE} as text from listing),
  {buckets('sentence', 'id', 'text', 64, 'sv')}, {buckets('listing', 'id', 'description', 64, 'dv')}
  select id, {digest('sv.v')} as structured, {digest('dv.v')} as description, id as listing_id,
  coalesce(furnished, false) as furnished from listing left join sv on sv.k = id left join dv on dv.k = id""",
    "nested_point": f"""with {INDEX} select id, {digest('sv')} as structured, {digest('dv')} as description, external_id, rooms from idx""",
    "embed_text": f"""with ask_text as (select 1 as query_id, 'the and of large room' as query),
  {buckets('documents', 'doc_id', 'text', 64, 'dv')}, {buckets('ask_text', 'query_id', 'query', 64, 'qv')}
  select dv.k as doc_id, {cos('dv.v', 'qv.v')} as score from dv, qv""",
    "listing_to_record": f"""with {LISTING} select {LISTING_FIELDS}, {CREATED_TEXT} as created_at, {CREATED_TEXT} as updated_at,
  {CREATED_TEXT} as scraped_at from listing""",
    "hash_embed": f"""with {buckets('documents', 'doc_id', 'text', 64, 'item')}
  select k as doc_id, b as bucket, round(cast(cast(w as float) as double), 6) as weight from item_cell""",
    "embed_listings": f"""with {LISTING}, sentence as (select id, {SENTENCE} as text from listing),
  {buckets('sentence', 'id', 'text', 64, 'sv')}, {buckets('listing', 'id', 'description', 64, 'dv')},
  cell as (select k, b, w, 'structured' as name from sv_cell union all select k, b, w, 'description' from dv_cell)
  select k as id, name, b as bucket, round(cast(cast(w as float) as double), 6) as weight from cell where w > 0""",
    "l2_normalize": """with x as (select vec_id, generate_subscripts(embedding, 1) - 1 as i, unnest(embedding)::double as x from embeddings)
  select vec_id, i, round(x / sqrt(sum(x*x) over (partition by vec_id)), 9) as x from x""",
    "vector_dim": "select len(embedding) as dim, count(*) as vectors from embeddings group by 1",
    "collection_info": f"""with {INDEX} select 'listings' as name, max(len(sv)) as vector_size, count(*) as points_count,
  'green' as status from idx""",
    "named_vectors": f"""with {INDEX}, v as (select 'structured' as name, len(sv) as dim from idx union all
  select 'description', len(dv) from idx)
  select name, count(*) as points_count, count(*) filter (dim is null) as missing, min(dim) as min_dim, max(dim) as max_dim
  from v group by name""",
    "scan_vectors": f"with {INDEX} select id, city, price, {digest('dv')} as digest from idx",
    "upsert_listings": f"""with {LISTING}, {BATCH}, known as (
    select l.id, l.external_id, b.external_id is not null as hit, l.title as t, b.title as bt, l.price as p, b.price as bp,
      l.rooms as r, b.rooms as br, l.furnished as f, coalesce(b.furnished, false) as bf
    from listing l left join batch b using (external_id)),
  fresh as (select *, row_number() over (order by external_id) + (select max(id) from listing) as id
    from batch where external_id not in (select external_id from listing))
  select id, external_id, case when hit then bt else t end as title, case when hit then bp else p end as price,
    case when hit then br else r end as rooms, case when hit then bf else f end as furnished,
    case when hit then 'updated' else 'kept' end as status, false as created_now, hit as updated_now, hit as scraped_now from known
  union all select id, external_id, title, price, rooms, coalesce(furnished, false), 'inserted', true, true, true from fresh""",
    "upsert_partial_batch": f"""with {LISTING}, b as (
    select 'ext-'||(id+{HALF}) as external_id, price+1000 as price from listing),
  fresh as (select *, row_number() over (order by external_id) + (select max(id) from listing) as id
    from b anti join listing using (external_id))
  select l.id, external_id, case when b.external_id is null then title end as title, case when b.external_id is null then l.price else b.price end as price,
    case when b.external_id is null then city end as city, b.external_id is null and has_parking as has_parking,
    case when b.external_id is null then furnished else false end as furnished, case when b.external_id is null then pets_allowed end as pets_allowed,
    case when b.external_id is null then 'kept' else 'updated' end as status from listing l left join b using (external_id)
  union all select id, external_id, null, price, null, false, false, null, 'inserted' from fresh""",
    "dedup_latest_feed": """select 'ext-'||k as external_id, arg_max(p_partkey, (p_partkey % 2) * 1000000000 + p_partkey)::int as price
  from (select p_partkey, p_partkey % 50 as k from part) group by k""",
    "ensure_tables": f"with {INGESTED} select id, external_id, price from stored",
    "latest_wins": f"""with {LISTING}, load as (
    select id, n, external_id, description, price + 100 * n as price, has_parking, to_timestamp(1700000000 + 3600 * ((id * 7 + n * 5) % 11) + n) as seen
    from listing, range(1, 4) as loads(n) where (id + n) % 4 > 0)
  select external_id, arg_max(description, seen) as description, arg_max(coalesce(price, -1), seen) as price,
    arg_max(n, seen)::int as load, epoch(max(seen))::bigint as seen from load group by external_id""",
    "load_stats": f"""with {RAW}, {CLEANED} select cast(0 as bigint) as inserted, count(*) filter (rooms is null or rooms < 99.95) as updated,
  count(*) filter (rooms >= 99.95) as errors, count(*) as total_listings from cleaned""",
    "dedup_by_key": """select external_id, event_id, event_type, value from (select 'ext-'||user_id as external_id, event_id, event_type, value,
  row_number() over (partition by user_id order by ts desc nulls last, event_id desc) as place from events) where place = 1""",
    "require_key": """select p_partkey, external_id, coalesce(length(external_id) > 0, false) as keyed from (
  select p_partkey, case when p_size%4=0 then '' when p_size%4<>1 then p_name end as external_id from part)""",
    "assign_ids": f"with {LISTING} select external_id, title, 1000 + row_number() over (order by external_id) as id from listing",
    "key_lookup": f"with {LISTING}, {BATCH} select l.id, external_id, b.price from batch b join listing l using (external_id)",
    "upsert_vectors": f"""with {INDEX}, points as materialized (select id, {digest('sv')} as s, {digest('dv')} as d from idx),
  moved as materialized (select id + (select count(*)//2 from points) as id, id as listing_id, d as structured, s as description from points)
  select * from moved union all select id, id, s, d from points anti join moved using (id)""",
    "vector_stats": f"with {LISTING} select count(*) as loaded, cast(0 as bigint) as errors from listing",
    "ingest": f"""with {INGESTED}, {SENTENCES} select id, external_id, title, description, price, round(rooms, 1) as rooms, size_sqm,
  has_parking, furnished, cast(pets_allowed as boolean) as pets_allowed, nullif(city, '') as city,
  {digest('sv.v')} as structured, {digest('dv.v')} as about from stored left join sv on sv.k = id left join dv on dv.k = id""",
    "ingest_stats": f"""with {RAW}, {CLEANED}, {GOOD}, unread as (select r.external_id,
    coalesce(trim(r.price) <> '' and c.price is null, false)::int + coalesce(trim(r.rooms) <> '' and c.rooms is null, false)::int
    + coalesce(trim(r.size_sqm) <> '' and c.size_sqm is null, false)::int as cells from raw r join cleaned c using (external_id)),
  n as (select count(*) as rows, count(*) filter (length(external_id) % 3 = 0) as part, coalesce(sum(u.cells), 0) as cells,
    coalesce(sum(u.cells) filter (length(external_id) % 3 = 0), 0) as part_cells from good join unread u using (external_id)),
  bad as (select count(*) as rows, count(*) filter (length(external_id) % 3 = 0) as part from cleaned where rooms >= 99.95)
  select n.part as inserted, cast(0 as bigint) as updated, cast(0 as bigint) as late, cast(0 as bigint) as duplicates, bad.part as errors,
    cast(part_cells as bigint) as unread_values, n.part as total_listings, 1 as load from n, bad
  union all select n.rows - n.part, n.part, 0, n.rows, 2 * bad.rows, cast(2 * cells as bigint), n.rows, 2 from n, bad""",
    "stream_ingest": f"with {INGESTED} select external_id, title, price, has_parking, true as loaded from stored",
    "stream_dedup": """select 'ext-'||p_partkey as external_id, 'flat '||p_partkey as description,
  (case when p_partkey % 3 > 0 then 2000 else 1000 end + p_partkey % 7)::int as price, case when p_partkey % 3 > 0 then 3 else 2 end as day from part""",
    "price_history": """with seen as (
    select user_id, ts, max(floor(value / 20)::int) as level from events where event_type = 'view' group by all),
  told as (select *, lag(level) over w as before, row_number() over w as n from seen window w as (partition by user_id order by ts)),
  opened as (select * from told where n = 1 or before is distinct from level)
  select user_id, level, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') as valid_from,
    strftime(lead(ts) over (partition by user_id order by ts), '%Y-%m-%d %H:%M:%S.%f') as valid_to from opened""",
    "price_as_of": """select p.event_id, p.user_id, v.event_id as seen_id, v.value as price
  from (select * from events where event_type = 'purchase') p asof left join (select * from events where event_type = 'view') v
  on p.user_id = v.user_id and p.ts >= v.ts""",
    "collection_profile": f"""with {INDEX}, cell as (select unnest(['price', 'rooms', 'city']) as "column",
    unnest([price::varchar, rooms::varchar, nullif(city, '')]) as value from idx)
  select "column", count(*) as rows, count(*) filter (value is null) as nulls, true as distinct_within, true as quantiles_within from cell group by 1""",
    "read_listings": f"with {RAW} select external_id, title, description, price, rooms, city from raw",
    "snapshot_tables": f"""with {INDEX} select l.id, l.external_id, l.id % 64 as id_block, i.price, i.city
  from listing l left join idx i on i.id = l.id""",
    "compare_rankings": f"with {COMPARED} select * exclude (a3, b3) from compared",
    "top_ids": f"""with {INDEX}, {EACH}, {top(cos('qv', 'dv'), 'idx', 5)}
  select query_id, array_to_string(list(id order by rank), ',') as top_ids, max(score) as top_score from hit group by query_id""",
    "overlap_at_k": f"with {COMPARED} select query_id, overlap_count, overlap_ratio from compared",
    "expected_hit": f"""with {COMPARED}, f as (select query_id, list_contains(a3, query_id) as r, list_contains(b3, query_id) as m from compared)
  select query_id, r as regular_found, m as multivector_found, m and not r as missed_by_regular, r and not m as missed_by_multivector from f""",
    "evaluation_summary": f"""with {COMPARED} select count(*) as queries, count(*) filter (top_changed) as top_changed_count,
  round(avg(overlap_ratio), 6) as avg_overlap, round(avg(score_improvement), 6) as avg_score_improvement,
  avg(score_improvement) > 0 as improves, count(*) filter (top_changed) * 2 > count(*) as changes_ranking from compared""",
    "compare_models": f"select * from ({best_per_model(16)}) union all select * from ({best_per_model(64)})",
    "timing_summary": """with t as (select 10.0::double as e, (value / 1000 + 1) * 1000 as r, (value / 900 + 1.1) * 1000 as m from events)
  select round(avg(e), 6) as avg_query_encode_time_ms, round(avg(r), 6) as avg_regular_time_ms, round(avg(m), 6) as avg_multivector_time_ms,
  round((avg(m) / avg(r) - 1) * 100, 6) as overhead_percent, (avg(m) / avg(r) - 1) * 100 < 20 as overhead_minimal from t""",
    "display_card": f"""with {LISTING}, s as (select *, rooms/7 as score from listing) select id,
  '#'||(id+1)||' - '||coalesce(title, 'ללא כותרת')||' | דמיון: '||printf('%.2f', score*100)||'%' as card_title,
  coalesce('₪'||format('{{:,}}', price), 'לא צוין') as price_text, coalesce({ROOMS_TEXT}, 'לא צוין') as rooms_text,
  coalesce(case when size_sqm <> 0 then size_sqm||' מ²' end, 'לא צוין') as size_text,
  case when pets_allowed is null then 'לא צוין' when pets_allowed then 'כן' else 'לא' end as pets_text,
  concat_ws(', ', nullif(city, ''), nullif(location, ''), nullif(neighborhood, '')) as place_line,
  concat_ws(', ', 'קומה '||floor, 'מתוך '||total_floors||' קומות') as floor_line,
  concat_ws(' | ', {CARD_FLAGS}) as feature_line,
  printf('%.1f', score*100)||'%' as score_text from s""",
}
