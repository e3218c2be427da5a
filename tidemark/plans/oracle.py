"""DuckDB SQL of the engine's queries, built from shared common table expressions."""

from __future__ import annotations

import math

K, M, RECENT, STEPS, USERS = 3, 10, 10, 10, 200

LOG = "log as (select user_id, try_cast(props ->> '$.k' as bigint) as item_id, ts, event_id from events)"
DEDUP = "dedup as (select user_id, item_id, ts from (select *, row_number() over (partition by user_id, item_id order by ts, event_id) as n from log where user_id is not null and item_id is not null) where n = 1)"
EVENTS = f"{LOG}, {DEDUP}, inter as (select user_id, item_id, ts from (select *, count(item_id) over (partition by user_id) as n from dedup) where n between 20 and 200)"
BOUGHT = """pairs as (select o_custkey as user_id, l_partkey as item_id, o_orderdate as ts, row_number() over (partition by o_custkey, l_partkey order by o_orderdate, l_orderkey, l_linenumber) as n
 from lineitem join orders on l_orderkey = o_orderkey),
active as (select user_id, item_id, ts from (select *, count(item_id) over (partition by user_id) as c from pairs where n = 1) where c between 20 and 200)"""


MONTHS = """pairs as (select o_custkey as user_id, 12 * l_partkey + month(o_orderdate) - 1 as item_id, o_orderdate as ts, row_number() over (partition by o_custkey, 12 * l_partkey + month(o_orderdate) order by o_orderdate, l_orderkey, l_linenumber) as n
 from lineitem join orders on l_orderkey = o_orderkey),
inter as (select user_id, item_id, ts from (select *, count(item_id) over (partition by user_id) as c from pairs where n = 1) where c between 20 and 200)"""
PURCHASES = f"{BOUGHT}, inter as (select * from active)"


SPLIT = """split as (select *, rn > n_train as is_test from (select *, n - greatest(1, cast(round(0.2 * n) as bigint)) as n_train
 from (select *, row_number() over (partition by user_id order by ts, item_id) as rn, count(*) over (partition by user_id) as n from inter))),
train as materialized (select * from split where not is_test), test as (select * from split where is_test),
tail as (select item_id from train group by item_id having count(*) = 1), users as (select distinct user_id from train),
vec as materialized (select vec_id as item_id, cast(embedding as double[]) as v from embeddings where vec_id in (select item_id from split))"""


VECTORS = "select vec_id as item_id, cast(embedding as double[]) as v from embeddings"
#: The January items' vectors, numbered by the part modulo the number of vectors.
MONTH_VECTORS = "select 12 * p_partkey as item_id, cast(embedding as double[]) as v from part join embeddings on vec_id = p_partkey % (select count(*) from embeddings)"


def base(fixture: str) -> str:
    if fixture is MONTHS:
        return f"{fixture}, {SPLIT}".replace(f"{VECTORS} where vec_id in", f"select * from ({MONTH_VECTORS}) where item_id in")
    return f"{fixture}, {SPLIT}"


def top(name: str, scored: str, m: int = M) -> str:
    return f"{name} as materialized (select user_id, item_id, score, cast(rank as int) as rank from (select *, row_number() over (partition by user_id order by score desc, item_id) as rank from ({scored})) where rank <= {m})"


NEW = "not exists (select 1 from train t where t.user_id = {u}.user_id and t.item_id = {i}.item_id)"
UNSEEN = NEW.format(u="u", i="i")
#: Every user's permutation of the catalog's places, a network of four rounds walked until it is below the catalog's size.
ROUNDS = ((1540483477, 15, 668265263), (741103597, 13, 1540483477), (1274126177, 16, 741103597), (668265263, 14, 1274126177))


def _permutation() -> str:
    """Common table expressions draw(user_id, k, pos): the place that draw k of a user gives."""
    word, out = "4294967295", []
    out.append("place as materialized (select item_id, row_number() over (order by item_id) - 1 as pos from vec), total as (select count(*) as n from place), size as (select n, (select min(b) from range(1, 31) r(b) where (1::bigint << (2 * b)::int) >= n) as b from total)")
    out.append("keyed as (select user_id, md5(cast(user_id as varchar)) as h, count(*) as n_seen from train group by user_id)")
    keys = ", ".join(f"cast(concat('0x', substr(h, {1 + 8 * r}, 8)) as bigint) as k{r}" for r in range(4))
    out.append(f"start as (select user_id, n, b::int as b, (1::bigint << b::int) - 1 as mask, {keys}, unnest(range(least(n, n_seen + {M}))) as k from keyed, size)")
    names, rounds = "user_id, n, b, mask, k0, k1, k2, k3, k", "select *, x >> b as l0, x & mask as r0 from walk where x < 0 or x >= n or step = 0"
    for r, (factor, shift, other) in enumerate(ROUNDS):
        rounds = f"select *, xor(l{r}, xor(z{r}, z{r} >> 16) & mask) as r{r + 1}, r{r} as l{r + 1} from (select *, (xor(y{r}, y{r} >> {shift}) * {other}) & {word} as z{r} from (select *, (xor(r{r}, k{r}) * {factor}) & {word} as y{r} from ({rounds})))"
    out.append(f"walk as (select {names}, k::bigint as x, 0 as step from start union all select {names}, (l4 << b) | r4, step + 1 from ({rounds}))")
    out.append("draw as (select user_id, k, x as pos from walk where step > 0 and x < n)")
    return ", ".join(out)


RANDOM = f"""{_permutation()}, rec_random as materialized (select user_id, item_id, cast(-rank as double) as score, cast(rank as int) as rank from (select u.user_id, i.item_id,
 row_number() over (partition by u.user_id order by u.k) as rank from draw u join place i using (pos) where {UNSEEN}) where rank <= {M})"""
POPULAR = top("rec_popular", f"select u.user_id, i.item_id, cast(i.n as double) as score from users u, (select item_id, count(*) as n from train group by item_id) i where {UNSEEN}")
AFFINITY = "weight as (select item_id, 1 / sqrt(cast(count(*) as double)) as w from train group by item_id), affinity as materialized (select a.user_id, b.user_id as other, sum(w) as weight from train a join weight using (item_id) join train b using (item_id) group by all)"
KNN_SCORED = f"select u.user_id, i.item_id, coalesce(round(s * w, 6), 0.0) as score from users u cross join weight i left join (select a.user_id, t.item_id, sum(weight) as s from affinity a join train t on t.user_id = a.other group by all) x on x.user_id = u.user_id and x.item_id = i.item_id where {UNSEEN}"
KNN = AFFINITY + ", " + top("rec_knn", KNN_SCORED)
KNN_FILL = AFFINITY + ", " + top("rec_fill", f"{KNN_SCORED} union all select u.user_id, i.item_id, -1.0 from users u, vec i where i.item_id not in (select item_id from train)") + ", rec_knn as (select user_id, item_id, greatest(score, 0.0) as score, rank from rec_fill)"


def means(name: str, source: str, keys: str = "user_id") -> str:
    """(keys, v) means of the vectors v of source."""
    return f"{name} as materialized (select {keys}, list(x order by d) as v from (select {keys}, d, avg(v[d]) as x from (select {keys}, v, unnest(range(1, len(v) + 1)) as d from {source}) group by all) group by {keys})"


HISTORY = "hist as materialized (select t.user_id, t.item_id, t.rn, t.n_train, v from train t join vec using (item_id))"
PAIR_HISTORY = "hist as materialized (select t.user_id, t.item_id, t.rn, t.n_train, cast(embedding as double[]) as v from train t join embeddings on vec_id = (31 * t.user_id + t.item_id) % (select count(*) from embeddings))"
PROFILE = means("profile", "hist")
LENGTH = "sqrt(list_dot_product({0}, {0}))"


def nearest(name: str, queries: str, m: int = M) -> str:
    score = f"round(list_dot_product(u.v, i.v) / ({LENGTH.format('u.v')} * {LENGTH.format('i.v')} + 1e-8), 6)"
    return top(name, f"select u.user_id, i.item_id, {score} as score from {queries} u, vec i where {UNSEEN}", m)


def clusters(k: int = K) -> str:
    """c(user_id, cluster, v): Lloyd's steps, unrolled, from the earliest vector and the farthest others."""
    out = ["pts as (select *, count(*) over (partition by user_id) as n_vec, row_number() over (partition by user_id order by rn, item_id) as k from hist)",
           f"p as materialized (select * from pts where n_vec >= {k})", "s0 as materialized (select user_id, 0 as cluster, v from p where k = 1)"]
    for j in range(1, k):
        out.append(f"""s{j} as materialized (select * from s{j - 1} union all select user_id, {j}, v from (select user_id, v, row_number() over (partition by user_id order by far desc, k > 1, item_id) as pick
 from (select p.user_id, p.item_id, p.k, any_value(p.v) as v, min(round(list_distance(p.v, s.v), 9)) as far from p join s{j - 1} s using (user_id) group by p.user_id, p.item_id, p.k)) where pick = 1)""")
    last = f"s{k - 1}"
    for i in range(STEPS):
        out.append(f"a{i} as (select user_id, item_id, v, arg_min(cluster, (far, cluster)) as cluster from (select p.user_id, p.item_id, p.v, c.cluster, round(list_distance(p.v, c.v), 9) as far from p join {last} c using (user_id)) group by all)")
        out.append(means(f"m{i}", f"a{i}", "user_id, cluster"))
        out.append(f"c{i} as materialized (select o.user_id, o.cluster, coalesce(m.v, o.v) as v from {last} o left join m{i} m using (user_id, cluster))")
        last = f"c{i}"
    return ", ".join(out) + f", c as (select * from {last})"


def chosen(recent: int | None = RECENT, k: int = K) -> str:
    late = "hist" if recent is None else f"(select * from hist where rn > n_train - {recent})"
    return f"""{clusters(k)}, {means("target", late)},
active as materialized (select user_id, unnest(arg_min({{'cluster': cluster, 'v': v}}, (far, cluster))) from (select c.user_id, cluster, c.v, coalesce(round(list_distance(c.v, t.v), 9), 0.0) as far from c left join target t using (user_id)) group by user_id),
ask as (select user_id, v from active union all select user_id, v from profile where user_id not in (select user_id from active))"""


def active(recent: int | None = RECENT, k: int = K, m: int = M, history: str = HISTORY) -> str:
    return f"{history}, {PROFILE}, {chosen(recent, k).replace('active as', 'picked as').replace('from active', 'from picked')}, {nearest('rec_active', 'ask', m)}"


CONTENT = nearest("rec_content", "profile")
SYSTEMS = {"Random": "rec_random", "Popularity": "rec_popular", "ItemKNN": "rec_knn", "Content": "rec_content", "ActiveCentroid": "rec_active"}


def measured(name: str, lists: dict[str, str]) -> str:
    recs = " union all ".join(f"select '{s}' as system, user_id, item_id from {t} where rank <= {M}" for s, t in lists.items())
    systems = " union all ".join(f"select '{s}' as system" for s in lists)
    return f"""{name} as materialized (with size as (select user_id, count(*) as n, count(t.item_id) as n_lt from test left join tail t using (item_id) where user_id in (select user_id from train) group by user_id),
 hits as (select system, user_id, count(*) as h, count(t.item_id) as h_lt from ({recs}) join test using (user_id, item_id) left join tail t using (item_id) group by all)
 select user_id, system, coalesce(h, 0) / n as recall, case when n_lt > 0 then coalesce(h_lt, 0) / n_lt end as lt_recall from size cross join ({systems}) left join hits using (system, user_id))"""


def experiment(fixture: str = PURCHASES) -> str:
    return f"{base(fixture)}, {RANDOM}, {POPULAR}, {KNN}, {active()}, {CONTENT}, {measured('results', SYSTEMS)}"


def resampled(replicas: int = 10_000) -> str:
    """ci(place, system, metric, mean, low, high, n, hits): every user's Poisson weight in every replica, by the same hash."""
    cells = [(s, m) for s in SYSTEMS for m in ("recall", "lt_recall")]
    steps, term, total = [], math.exp(-1), 0.0
    for k in range(1, 14):
        total, term = total + term, term / k
        steps.append(f"(u >= {math.floor(total * 2**32)})::int")
    wide = ", ".join(f"max(case when system = '{s}' then {m} end) as x{i}" for i, (s, m) in enumerate(cells))
    means = ", ".join(f"sum(w * x{i}) / nullif(sum(w) filter (where x{i} is not null), 0) as m{i}" for i in range(len(cells)))
    rows = " union all ".join(f"select {i} as place, '{s}' as system, '{m}' as metric, (select avg({m}) from results where system = '{s}') as mean, quantile_cont(m{i}, 0.025) as low, quantile_cont(m{i}, 0.975) as high, (select count({m}) from results where system = '{s}') as n, (select count(*) from results where system = '{s}' and {m} > 0) as hits from boot" for i, (s, m) in enumerate(cells))
    return f"""keyed2 as (select user_id, md5(concat('42:', user_id)) as h from (select distinct user_id from results)),
 mixed as (select user_id, r, cast(concat('0x', substr(h, 9, 8)) as bigint) as b, (r * 1540483477 + cast(concat('0x', substr(h, 1, 8)) as bigint)) & 4294967295 as y from keyed2, range({replicas}) g(r)),
 mixed2 as (select user_id, r, b, (xor(y, y >> 15) * 741103597) & 4294967295 as y from mixed),
 mixed3 as (select user_id, r, (xor(xor(y, y >> 13), b) * 1274126177) & 4294967295 as y from mixed2),
 weighted as (select user_id, r, {" + ".join(steps)} as w from (select user_id, r, xor(y, y >> 16) as u from mixed3)),
 wide as (select user_id, {wide} from results group by user_id),
 boot as materialized (select r, {means} from weighted join wide using (user_id) group by r), ci as ({rows})"""


SUMMARY = "summary as (select system, avg(recall) as recall, avg(lt_recall) as lt_recall, count(*) as n_users, count(lt_recall) as n_eligible, count(*) filter (where recall > 0) as n_hit, count(*) filter (where lt_recall > 0) as n_lt_hit from results group by system)"
TURN = "turn as (select conv_id as doc_id, text as review from (select *, row_number() over (partition by conv_id order by turn, role, text) as n from conversations) where n = 1)"


def _overlap() -> str:
    flag = lambda c: f"(select distinct item_id, 1 as {c} from"
    both = lambda x, y, n: f"count(*) filter (where {x} is not null and {y} is not null) as {n}"
    return f"""with {{base}} select count(a) as train_items, count(b) as test_items, count(e) as vector_items, count(t) as tail_items, {both('a', 'b', 'train_test')}, {both('a', 'e', 'train_vector')}, {both('b', 'e', 'test_vector')}, {both('b', 't', 'test_tail')}, {both('t', 'e', 'tail_vector')}
 from {flag('a')} train) x full join {flag('b')} test) y using (item_id) full join ({{vectors}}) z using (item_id) full join {flag('t')} tail) w using (item_id)"""


OVERLAP = _overlap()
PROFILE_ROW = """with {base} select *, round((n_train + n_test) / n_users, 6) as rows_a_user, round(100 * n_tail / n_train_items, 6) as pct_tail from (select count(distinct user_id) as n_users, count(distinct item_id) as n_items,
 count(distinct item_id) filter (where not is_test) as n_train_items, count(*) filter (where not is_test) as n_train, count(*) filter (where is_test) as n_test, (select count(*) from tail) as n_tail from split)"""


def both_profiles(history: str) -> str:
    """The two vector systems' per-user recalls for one kind of history, as a query of its own."""
    return f"""(with {active(history=history)}, {CONTENT}, {measured("m", {"Content": "rec_content", "ActiveCentroid": "rec_active"})} select system, avg(recall) as r, avg(lt_recall) as l from m group by system)"""


def sql() -> dict[str, str]:
    ev, cp, mo, cols = base(EVENTS), base(PURCHASES), base(MONTHS), "user_id, item_id, score, rank"
    return {
        "dedup_interactions": f"with {LOG}, {DEDUP} select * from dedup",
        "user_activity": f"with {LOG}, {DEDUP} select user_id, count(item_id) as n from dedup group by user_id",
        "user_activity_filter": f"with {BOUGHT} select * from active",
        "user_sample": f"with {BOUGHT} select user_id from (select distinct user_id from active) order by md5(cast(user_id as varchar)), user_id limit {USERS}",
        "user_seed": "select distinct user_id, cast(concat('0x', substr(md5(cast(user_id as varchar)), 1, 8)) as bigint) as seed from events",
        "chrono_split_train": f"with {cp} select user_id, item_id, cast(rn as int) as rn from train",
        "chrono_split_test": f"with {cp} select user_id, item_id, cast(rn as int) as rn from test",
        "split_boundary_check": f"with {cp} select user_id, coalesce(max(ts) filter (where not is_test) <= min(ts) filter (where is_test), true) as in_order from split group by user_id",
        "eligible_users": f"with {cp} select user_id from train intersect select user_id from test",
        "item_popularity": f"with {cp} select item_id, count(*) as n from train group by item_id",
        "long_tail_items": f"with {cp} select item_id from tail",
        "rec_random_hash": f"with recursive {cp}, {RANDOM} select {cols} from rec_random",
        "rec_popularity": f"with {cp}, {POPULAR} select {cols} from rec_popular",
        "itemknn_affinity": f"with {ev}, {AFFINITY} select user_id, other, round(weight, 6) as weight from affinity",
        "rec_itemknn": f"with {cp}, {KNN} select {cols} from rec_knn",
        "rec_itemknn_fill": f"with {ev}, {KNN_FILL} select {cols} from rec_knn",
        "user_mean_vector": f"with {ev}, {HISTORY}, {PROFILE} select user_id, cast(d - 1 as int) as dim, round(v[d], 6) + 0.0 as value from (select user_id, v, unnest(range(1, len(v) + 1)) as d from profile)",
        "rec_content": f"with {cp}, {HISTORY}, {PROFILE}, {CONTENT} select {cols} from rec_content",
        "rec_content_block": f"with {ev}, {HISTORY}, {PROFILE}, {CONTENT} select {cols} from rec_content",
        "user_centroids": f"with {ev}, {HISTORY}, {clusters()} select user_id, cast(cluster as int) as cluster, cast(d - 1 as int) as dim, round(v[d], 6) + 0.0 as value from (select user_id, cluster, v, unnest(range(1, len(v) + 1)) as d from c)",
        "active_centroid": f"with {ev}, {active()} select user_id, cast(cluster as int) as cluster from picked",
        "rec_active_centroid": f"with {ev}, {active()} select {cols} from rec_active",
        "rec_active_centroid_tail": f"with {cp}, {active()}, {POPULAR} select {cols} from rec_active union all select {cols} from rec_popular where user_id not in (select user_id from ask)",
        "rec_active_centroid_k5": f"with {ev}, {active(k=5, m=20)} select {cols} from rec_active",
        "rec_mean_select": f"with {ev}, {active(recent=None)} select {cols} from rec_active",
        "rec_review_profile": f"with {cp}, {active(history=PAIR_HISTORY)} select {cols} from rec_active",
        "review_profile_delta": f"""with {cp}, {HISTORY}, {PROFILE}, {CONTENT}, {measured("one", {"Content": "rec_content"})},
 {PAIR_HISTORY.replace("hist as", "hist2 as")}, {means("profile2", "hist2")}, {nearest("rec_pair", "profile2")}, {measured("two", {"Content": "rec_pair"})}
 select 'Content' as system, round((select avg(recall) from two) - (select avg(recall) from one), 9) as recall_delta, round((select avg(lt_recall) from two) - (select avg(lt_recall) from one), 9) as lt_recall_delta""",
        "recall_per_user": f"with recursive {experiment()} select * from results",
        "system_summary": f"with recursive {experiment()}, {SUMMARY} select system, round(recall, 9) as recall, round(lt_recall, 9) as lt_recall, n_users, n_eligible, n_hit, n_lt_hit from summary",
        "lift_table": f"""with recursive {experiment()}, {SUMMARY} select system, round(recall / nullif((select recall from summary where system = 'Random'), 0), 6) as lift_empirical,
 round(recall / ({M} / (select count(*) from vec)), 6) as lift_theoretical, round(lt_recall / nullif((select lt_recall from summary where system = 'Content'), 0), 6) as lt_content_ratio from summary""",
        "ordering_check": f"with recursive {experiment()}, {SUMMARY} select (select recall from summary where system = 'ItemKNN') > (select recall from summary where system = 'Popularity') as in_order",
        "bootstrap_ci": f"with recursive {experiment()}, {resampled()} select place, system, metric, round(mean, 9) as mean, round(low, 9) as low, round(high, 9) as high, n, hits from ci where n > 0",
        "tail_items": f"with {mo} select item_id from tail",
        "tail_recall_per_user": f"with recursive {experiment(MONTHS)} select * from results",
        "tail_system_summary": f"with recursive {experiment(MONTHS)}, {SUMMARY} select system, round(recall, 9) as recall, round(lt_recall, 9) as lt_recall, n_users, n_eligible, n_hit, n_lt_hit from summary",
        "tail_lift_table": f"""with recursive {experiment(MONTHS)}, {SUMMARY} select system, round(recall / nullif((select recall from summary where system = 'Random'), 0), 6) as lift_empirical,
 round(recall / ({M} / (select count(*) from vec)), 6) as lift_theoretical, round(lt_recall / nullif((select lt_recall from summary where system = 'Content'), 0), 6) as lt_content_ratio from summary""",
        "tail_bootstrap_ci": f"with recursive {experiment(MONTHS)}, {resampled()} select place, system, metric, round(mean, 9) as mean, round(low, 9) as low, round(high, 9) as high, n, hits from ci where n > 0",
        "tail_overlap_profile": OVERLAP.format(base=mo, vectors=f"select item_id, 1 as e from ({MONTH_VECTORS})"),
        "tail_data_profile": PROFILE_ROW.format(base=mo),
        "tail_profile_delta": f"with {mo} select a.system, round(b.r - a.r, 9) as recall_delta, round(b.l - a.l, 9) as lt_recall_delta from {both_profiles(HISTORY)} a join {both_profiles(PAIR_HISTORY)} b using (system)",
        "tail_ordering_check": f"""with recursive {experiment(MONTHS)}, {SUMMARY}, one as (select max(lt_recall) filter (where system = 'ActiveCentroid') as a, max(lt_recall) filter (where system = 'Content') as c, max(lt_recall) filter (where system = 'ItemKNN') as i from summary)
 select coalesce(a > c and c > i, false) as in_order, round(a, 9) as activecentroid, round(c, 9) as content, round(i, 9) as itemknn from one""",
        "item_text": "select doc_id, concat(text, ' by ', case when doc_id % 7 <> 0 and source is not null then source else 'Unknown' end) as item_text from documents",
        "embedding_input": f"""with {TURN}, j as (select d.*, case when d.doc_id % 5 = 0 then concat(' ', chr(10), chr(9), ' ') else review end as r from documents d left join turn using (doc_id))
 select doc_id, case when length(trim(coalesce(r, ''), concat(' ', chr(10), chr(9), chr(13)))) > 0 then substr(r, 1, 500) else concat(text, ' by ', source, '. ', substr(text, 1, 200)) end as embedding_input,
 case when length(trim(coalesce(r, ''), concat(' ', chr(10), chr(9), chr(13)))) > 0 then 'review' else 'metadata' end as embedding_source from j""",
        "author_description": """select doc_id, case when doc_id % 6 = 3 then substr(concat('{broken ', source), 1, 50) when doc_id % 6 = 4 then concat('O''', source, ' A') when doc_id % 6 = 5 then concat('é "', source, '"') else source end as author,
 substr(case when doc_id % 6 < 2 then concat(source, ' ', lang) when doc_id % 6 = 2 then lang when doc_id % 6 = 3 then concat('[broken ', source) when doc_id % 6 = 4 then concat('it''s ', source, ' ', lang, ' "x" ab None')
  else concat(source, ' [''', lang, ''', 1] True') end, 1, 200) as description from documents""",
        "bucketed_split": f"with {cp} select user_id, item_id, cast(rn as int) as rn, case when is_test then 'test' else 'train' end as split from split",
        "prepared_rows": f"""with {BOUGHT}, s as (select cast(user_id as varchar) as user_id, item_id, row_number() over w as rn, count(*) over (partition by user_id) as n from active window w as (partition by user_id order by ts, cast(item_id as varchar))),
 said as (select cast(o_custkey as varchar) as user_id, l_partkey as item_id, arg_min(case when l_orderkey % 3 = 0 then concat(' ', chr(9), ' ') else concat(l_returnflag, ' says "', l_linestatus, '"', chr(10), ' of ', l_orderkey) end, (o_orderdate, l_orderkey)) as t from lineitem join orders on l_orderkey = o_orderkey where l_linenumber = 1 group by all),
 m as (select p_partkey as item_id, concat(p_name, ' by ', case p_partkey % 4 when 0 then p_brand when 1 then concat('O''', p_brand) when 2 then p_brand else concat('{{broken ', p_brand) end, '. ', case p_partkey % 4 when 0 then concat(p_type, ' ', p_name) when 1 then concat('it''s ', p_type) when 2 then p_type else concat('[broken ', p_type) end) as t from part)
 select user_id, cast(s.item_id as varchar) as item_id, case when rn > n - greatest(1, cast(round(0.2 * n) as bigint)) then 'test' else 'train' end as split, cast(rn as int) as rn,
 case when said.t is not null and length(trim(said.t, concat(' ', chr(9)))) > 0 then said.t else coalesce(m.t, ' by . ') end as embedding_input, case when said.t is not null and length(trim(said.t, concat(' ', chr(9)))) > 0 then 'review' else 'metadata' end as embedding_source
 from s left join said using (user_id, item_id) left join m on m.item_id = s.item_id""",
        "rejected_lines": "select 'reviews' as table, '{broken' as rejected, count(*) as n from lineitem join orders on l_orderkey = o_orderkey where l_linenumber = 2 having count(*) > 0",
        "streamed_tail": "select item_id from (select try_cast(props ->> '$.k' as bigint) * 1000 + event_id % 1000 as item_id, user_id from events) where item_id is not null group by item_id having count(distinct user_id) = 1",
        "join_coverage": f"""with {TURN} select count(*) as n_rows, round(100 * avg((l.doc_id is not null)::int), 6) as pct_labels, round(100 * avg((t.doc_id is not null)::int), 6) as pct_reviews,
 round(100 * avg((l.doc_id is not null and t.doc_id is not null)::int), 6) as pct_all from documents d left join (select distinct doc_id from labels) l using (doc_id) left join turn t using (doc_id)""",
        "matching_reviews": f"""with {TURN}, e as (select user_id, try_cast(props ->> '$.k' as bigint) as item_id, event_type from events)
 select (select count(*) from turn where doc_id in (select doc_id from labels)) as n_labelled_turns,
 (select count(*) from e where exists (select 1 from e b where b.event_type = 'purchase' and b.user_id = e.user_id and b.item_id = e.item_id)) as n_pair_events""",
        "overlap_profile": OVERLAP.format(base=cp, vectors="select vec_id as item_id, 1 as e from embeddings"),
        "data_profile": PROFILE_ROW.format(base=cp),
        "hash_embedding": """with w as (select doc_id, unnest(regexp_split_to_array(lower(text), '[^a-z0-9]+')) as w from documents),
 c as (select doc_id, cast(cast(concat('0x', substr(md5(w), 1, 8)) as bigint) % 64 as int) as dim, cast(count(*) as double) as n from w where w <> '' group by all)
 select doc_id, dim, round(n / sqrt(sum(n * n) over (partition by doc_id)), 6) as value from c""",
        "csv_roundtrip": "select doc_id, lang, concat('a \"quoted\", ', chr(10)) || text as text from documents",
        "tsv_roundtrip": "select cast(user_id as varchar) as user_id, strftime(ts, '%Y-%m-%d %H:%M:%S') as timestamp, cast(event_id as varchar) as artist_id, event_type as artist_name, props ->> '$.k' as track_id, 'None' as track_name from events",
        "jsonl_roundtrip": "select doc_id, text, lang, source from documents",
        "parquet_stage": f"with {cp} select item_id, count(*) as n from train group by item_id",
    }
