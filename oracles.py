"""SQL answers the registered queries are checked against (DuckDB dialect).

Every statement starts from the given tables and states the operator its own
way; only the texts of reject reasons are shared with the Spark code.
"""

from __future__ import annotations

from flamelake.operators.normalize import REASONS

SAMPLES = """
samples as (
  select
    cast(10000000000 as bigint) as duration,
    case when l_linenumber % 2 = 1 then 'process_cpu' else 'process_mem' end as name,
    case when l_linenumber % 2 = 1 then 'samples' else 'alloc' end as sample_type,
    case when l_linenumber % 2 = 1 then 'count' else 'bytes' end as sample_unit,
    case when l_linenumber % 2 = 1 then 'cpu' else 'space' end as period_type,
    case when l_linenumber % 2 = 1 then 'nanoseconds' else 'bytes' end as period_unit,
    list_concat(
      list_concat(
        case when l_returnflag = 'N' then [] else [
          {'fn': p_name, 'bin': '/opt/shop/' || lower(p_type), 'build': 'b' || lower(p_type),
           'addr': 4194304 + cast('0x' || substr(md5(p_name || p_type || p_size), 1, 8) as bigint) * 16, 'line': cast(p_size as bigint), 'src': lower(p_type) || '.rs'}] end,
        case when l_linenumber = 7 then [
          {'fn': p_brand, 'bin': '/usr/lib/libbrand.so', 'build': 'blib', 'addr': 4198400 + cast(substr(p_brand, 7) as integer) * 64,
           'line': cast(7 as bigint), 'src': 'brand.c'},
          {'fn': p_brand, 'bin': '/usr/lib/libbrand.so', 'build': 'blib', 'addr': 4198400 + cast(substr(p_brand, 7) as integer) * 64,
           'line': cast(7 as bigint), 'src': 'brand.c'}]
        else [
          {'fn': p_brand, 'bin': '/usr/lib/libbrand.so', 'build': 'blib', 'addr': 4198400 + cast(substr(p_brand, 7) as integer) * 64,
           'line': cast(7 as bigint), 'src': 'brand.c'}] end),
      [{'fn': n_name, 'bin': '/usr/bin/python3.11', 'build': 'bpy', 'addr': 4202496 + n_nationkey * 16,
        'line': cast(n_nationkey as bigint), 'src': 'region_' || n_regionkey || '.py'},
       {'fn': 'main', 'bin': '/usr/bin/app', 'build': 'bapp', 'addr': 4206592,
        'line': cast(1 as bigint), 'src': 'main.c'}]) as stack,
    epoch_ms(l_shipdate) as timestamp,
    cast(l_quantity as bigint) as value,
    n_name as node,
    case when l_returnflag <> 'N' then l_returnflag end as pod,
    case when l_linestatus = 'O' then 'x86_64' else 'aarch64' end as arch
  from lineitem
  join part on l_partkey = p_partkey
  join supplier on l_suppkey = s_suppkey
  join nation on s_nationkey = n_nationkey),
named as (
  select *, list_transform(stack, lambda f: f.fn) as names from samples)
"""

CPU = (
    "name = 'process_cpu' and sample_type = 'samples' and sample_unit = 'count' "
    "and period_type = 'cpu' and period_unit = 'nanoseconds'"
)
BUSIEST = "(select timestamp from samples group by 1 order by count(*) desc, timestamp limit 1)"
PROFILE = (
    "select array_to_string(list_transform(stack, lambda f: f.fn), ';') as stack, "
    "stack[1].addr as leaf_address, {measures} from ({source})"
)


def with_samples(body: str) -> str:
    return f"with {SAMPLES} {body}"


def profile(source: str, measures: str = "cast(v as bigint) as value") -> str:
    return with_samples(PROFILE.format(measures=measures, source=source))


def diff(absolute: bool) -> str:
    a, b = "arch = 'aarch64'", "arch = 'x86_64'"
    scaled = (
        "coalesce(a, 0)"
        if absolute
        else f"""coalesce(cast(a as hugeint), 0)
          * cast((select sum(value) from samples where {b}) as hugeint)
          // cast((select sum(value) from samples where {a}) as hugeint)"""
    )
    return profile(
        f"""select coalesce(l.stack, r.stack) as stack, coalesce(b, 0) as v, coalesce(b, 0) - {scaled} as d
            from (select stack, sum(value) as a from samples where {a} group by 1) l
            full outer join (select stack, sum(value) as b from samples where {b} group by 1) r
              on l.stack = r.stack""",
        "cast(v as bigint) as value, cast(d as bigint) as diff",
    )


def cpu_diff(tail: str) -> str:
    """CPU samples per stack on two architectures: value of the second and difference from the scaled first."""
    return with_samples(f""",
sides as (
  select stack, names, coalesce(sum(value) filter (arch = 'aarch64'), 0) as a, coalesce(sum(value) filter (arch = 'x86_64'), 0) as b
  from named where name = 'process_cpu' group by 1, 2),
totals as (select cast(sum(a) as hugeint) as ta, cast(sum(b) as hugeint) as tb from sides),
compared as (select stack, names, b as v, b - coalesce(cast(a as hugeint) * tb // nullif(ta, 0), 0) as d from sides, totals)
{tail}""")


PLACES = "list_transform(stack, lambda f: {'build_id': f.build, 'binary': f.bin, 'name': f.fn, 'file': f.src})"
PLACE_STEP = (
    "lambda x, y: md5(x || '|' || length(y.build_id) || '|' || y.build_id || '|' || length(y.binary) || '|' || y.binary"
    " || '|' || length(y.name) || '|' || y.name || '|' || length(y.file) || '|' || y.file)"
)


def place_nodes(measures: str) -> str:
    """Nodes of ``paths(path, v, d)``, whose elements are functions in their binaries and files."""
    return f"""
prefixes as (
  select path[1:i] as prefix, i = len(path) as own, v, d
  from (select path, v, d, unnest(generate_series(1, len(path))) as i from paths))
select list_reduce(prefix, {PLACE_STEP}, '') as node_id, list_reduce(prefix[1 : len(prefix) - 1], {PLACE_STEP}, '') as parent_id,
       cast(len(prefix) - 1 as integer) as depth, prefix[-1].build_id as build_id, prefix[-1].binary as "binary",
       prefix[-1].name as name, prefix[-1].file as file, {measures}
from prefixes group by prefix"""


def place_edges(stacks: str) -> str:
    ends = ", ".join(f"{end}.{field} as {end}_{field}" for end in ("caller", "callee") for field in ("build_id", "binary", "name", "file"))
    return cpu_diff(f""",
  numbered as (select row_number() over () as id, {PLACES} as names, v, d from compared),
  {stacks},
  edges as (
    select caller, callee, is_collapsed, cast(sum(v) as bigint) as cumulative, cast(sum(d) as bigint) as cumulative_diff
    from (select distinct id, v, d, frames[i + 1].name as caller, frames[i].name as callee, frames[i + 1].pos - frames[i].pos > 1 as is_collapsed
          from (select *, unnest(generate_series(1, len(frames) - 1)) as i from stacks))
    group by all)
  select {ends}, is_collapsed, cumulative, cumulative_diff from edges""")


def flame(path: str, tail: str) -> str:
    """Nodes as (path prefix, depth, name) with sums, then the digest of each path."""
    return with_samples(f""",
paths as (
  select path, sum(value) as value from (select {path} as path, value from named) group by 1),
prefixes as (
  select path[1:i] as prefix, i - 1 as depth, path[i] as name,
         i = len(path) as own, value
  from (select path, value, unnest(generate_series(1, len(path))) as i from paths)),
nodes as (
  select list_reduce(list_concat([''], prefix), lambda x, y: md5(x || '|' || y)) as node_id,
         list_reduce(list_concat([''], prefix[1:depth]), lambda x, y: md5(x || '|' || y)) as parent_id,
         cast(depth as integer) as depth, name,
         cast(sum(value) as bigint) as cumulative,
         cast(sum(case when own then value else 0 end) as bigint) as flat
  from prefixes group by prefix, depth, name)
{tail}""")


TOP = """
select f as {name}, cast(sum(value) as bigint) as cumulative,
       cast(sum(case when f = names[1] then value else 0 end) as bigint) as flat
from (select names, value, unnest(list_distinct(names)) as f from named) group by 1
"""

EDGES = """
select caller, callee, is_collapsed, cast(sum(value) as bigint) as cumulative from (
  select distinct id, value, frames[i + 1].name as caller, frames[i].name as callee,
         frames[i + 1].pos - frames[i].pos > 1 as is_collapsed
  from (select *, unnest(generate_series(1, len(frames) - 1)) as i from stacks))
group by all
"""

QUERY_ORACLES: dict[str, str] = {
    "single_profile": profile(
        f"""select stack, sum(value) as v from samples
            where {CPU} and arch = 'aarch64' and timestamp = {BUSIEST} group by 1"""
    ),
    "merge_profile": profile(
        f"""select stack, sum(value) as v from samples
            where {CPU} and arch = 'aarch64' and timestamp between 0 and 4102444800000 group by 1"""
    ),
    "query_range": with_samples(f"""
        select name, sample_type, sample_unit, period_type, period_unit, node, pod, arch, timestamp - timestamp % 2592000000 as bucket,
               cast(sum(v) as bigint) as value, cast(sum(d) as bigint) as duration,
               sum(v) / 2592000.0 as value_per_second
        from (select name, sample_type, sample_unit, period_type, period_unit, node, pod, arch, timestamp, sum(value) as v, max(duration) as d
              from samples where {CPU} and arch = 'aarch64' group by all)
        group by name, sample_type, sample_unit, period_type, period_unit, node, pod, arch, bucket"""),
    "query_range_sum_by": with_samples("""
        select name, sample_type, sample_unit, period_type, period_unit, node, timestamp - timestamp % 2592000000 as bucket,
               cast(sum(v) as bigint) as value, cast(sum(d) as bigint) as duration,
               sum(v) / 2592000.0 as value_per_second
        from (select name, sample_type, sample_unit, period_type, period_unit, node, pod, arch, timestamp, sum(value) as v, max(duration) as d
              from samples group by all)
        group by name, sample_type, sample_unit, period_type, period_unit, node, bucket"""),
    "query_range_limit": with_samples("""
        select name, sample_type, sample_unit, period_type, period_unit, node, timestamp - timestamp % 2592000000 as bucket,
               cast(sum(v) as bigint) as value, cast(sum(d) as bigint) as duration,
               sum(v) / 2592000.0 as value_per_second
        from (select name, sample_type, sample_unit, period_type, period_unit, node, pod, arch, timestamp, sum(value) as v, max(duration) as d
              from samples group by all
              order by timestamp desc, name, sample_type, sample_unit, period_type, period_unit, arch nulls first, node nulls first, pod nulls first limit 100)
        group by name, sample_type, sample_unit, period_type, period_unit, node, bucket"""),
    "profile_types": with_samples("""
        select distinct name, sample_type, sample_unit, period_type, period_unit, duration <> 0 as delta
        from samples"""),
    "label_names": with_samples("""
        select distinct label_name from (
          select 'node' as label_name, node as v from samples
          union all select 'pod', pod from samples
          union all select 'arch', arch from samples) where v is not null"""),
    "label_values": with_samples("select distinct node as label_value from samples where node is not null"),
    "label_values_of_map": with_samples("""
        select distinct case when month(epoch_ms(timestamp)) % 2 = 1 then 'odd' else 'even' end as label_value
        from samples where month(epoch_ms(timestamp)) <> 12"""),
    "label_values_indexed": with_samples("""
        select label_name, label_value, count(*) as samples from (
          unpivot (
            select node, pod, arch,
                   case when month(epoch_ms(timestamp)) % 2 = 1 then 'odd' when month(epoch_ms(timestamp)) <> 12 then 'even' end as team
            from samples)
          on node, pod, arch, team into name label_name value label_value)
        group by 1, 2"""),
    "query_range_map_labels": with_samples(f"""
        select name, sample_type, sample_unit, period_type, period_unit, 'odd' as team, node, timestamp - timestamp % 2592000000 as bucket,
               cast(sum(v) as bigint) as value, cast(sum(d) as bigint) as duration,
               sum(v) / 2592000.0 as value_per_second
        from (select name, sample_type, sample_unit, period_type, period_unit, node, pod, arch, timestamp, sum(value) as v, max(duration) as d
              from samples where {CPU} and arch = 'aarch64' and month(epoch_ms(timestamp)) % 2 = 1 group by all)
        group by name, sample_type, sample_unit, period_type, period_unit, node, bucket"""),
    "profile_metadata": with_samples("""
        select distinct 'binary' as kind, split_part(b, '/', -1) as name
        from (select unnest(list_transform(stack, lambda f: f.bin)) as b from samples)
        union select 'label', 'node' from samples where node is not null
        union select 'label', 'pod' from samples where pod is not null
        union select 'label', 'arch' from samples where arch is not null"""),
    "top_functions": with_samples(TOP.format(name='"function"')),
    "flamegraph": flame("list_reverse(names)", "select * from nodes"),
    "flamegraph_layout": flame(
        "list_reverse(names)",
        """,
earlier as (
  select node_id, coalesce(sum(cumulative) over (
           partition by parent_id order by name rows between unbounded preceding and 1 preceding), 0) as taken from nodes),
ids as (
  select prefix, list_reduce(list_concat([''], prefix), lambda x, y: md5(x || '|' || y)) as node_id,
         row_number() over (order by prefix) - 1 as record
  from (select distinct prefix from prefixes)),
above as (
  select node_id, list_reduce(list_concat([''], prefix[1:i]), lambda x, y: md5(x || '|' || y)) as up
  from (select *, unnest(generate_series(1, len(prefix))) as i from ids)),
lefts as (
  select a.node_id, cast(sum(taken) as bigint) as "left" from above a join earlier e on e.node_id = a.up group by 1),
kids as (
  select n.parent_id as node_id, string_agg(cast(record as varchar), ',' order by record) as children
  from nodes n join ids i on i.node_id = n.node_id group by 1)
select n.*, i.record, l."left", coalesce(k.children, '') as children
from nodes n join ids i on i.node_id = n.node_id join lefts l on l.node_id = n.node_id left join kids k on k.node_id = n.node_id""",
    ),
    "flamegraph_inverted": flame("names", "select * from nodes"),
    "flamegraph_trimmed": flame(
        "list_reverse(names)",
        """select * from nodes
           where cast(cumulative as double) * 100 >= 0.5 * (select sum(value) from samples)""",
    ),
    "flamegraph_summary": flame(
        "list_reverse(names)",
        """, total as (select sum(value) as t from samples),
        kept as (select * from nodes where cast(cumulative as double) * 100 >= 0.5 * (select t from total)),
        removed as (select * from nodes where cast(cumulative as double) * 100 < 0.5 * (select t from total))
        select cast((select t from total) as bigint) as total,
               (select max(depth) + 1 from kept) as height,
               cast((select sum(cumulative) from removed
                     where parent_id = '' or parent_id in (select node_id from kept)) as bigint) as trimmed""",
    ),
    "flamegraph_group_by": flame(
        "list_concat([arch, coalesce(pod, '')], list_reverse(names))", "select * from nodes"
    ),
    "callgraph_nodes": with_samples(TOP.format(name="name")),
    "callgraph_edges": with_samples(""",
        stacks as (
          select row_number() over () as id, value,
                 list_transform(names, lambda x, i: {'pos': i, 'name': x}) as frames from named)"""
        + EDGES),
    "callgraph_trimmed": with_samples(""",
        kept as (
          select f from (select value, unnest(list_distinct(names)) as f from named)
          group by 1 having cast(sum(value) as double) * 100 >= 4.0 * (select sum(value) from named)),
        numbered as (select row_number() over () as id, names, value from named),
        exploded as (
          select id, value, unnest(names) as f, generate_subscripts(names, 1) as pos from numbered),
        stacks as (
          select id, value, list({'pos': pos, 'name': f} order by pos) as frames
          from exploded where f in (select f from kept) group by 1, 2)"""
        + EDGES),
    "diff_absolute": diff(True),
    "diff_relative": diff(False),
    "stack_filter": profile(
        """select stack, sum(value) as v from samples
           where len(list_filter(stack, lambda f: contains(lower(f.fn), 'widget'))) > 0 group by 1"""
    ),
    "frame_filter": profile(
        """select stack, sum(value) as v from (
             select list_filter(stack, lambda f: split_part(f.bin, '/', -1) in ('libbrand.so', 'app')) as stack,
                    value from samples)
           where len(stack) > 0 group by 1"""
    ),
    "runtime_filter": profile(
        """select stack, sum(value) as v from (
             select list_filter(stack, lambda f: f.bin <> '/usr/bin/python3.11') as stack, value from samples)
           where len(stack) > 0 group by 1"""
    ),
    "runtime_interpreted_only": profile(
        """select stack, sum(value) as v from (
             select list_filter(stack, lambda f: f.bin = '/usr/bin/python3.11') as stack, value from samples)
           where len(stack) > 0 group by 1"""
    ),
    "filter_totals": with_samples("""
        select cast(sum(case when pod = 'A' then value else 0 end) as bigint) as total,
               cast(sum(case when pod = 'A' then 0 else value end) as bigint) as filtered
        from samples"""),
    "top_diff": cpu_diff("""
        select f as "function", cast(sum(v) as bigint) as cumulative, cast(sum(d) as bigint) as cumulative_diff,
               cast(sum(case when f = names[1] then v else 0 end) as bigint) as flat,
               cast(sum(case when f = names[1] then d else 0 end) as bigint) as flat_diff
        from (select names, v, d, unnest(list_distinct(names)) as f from compared) group by 1"""),
    "flamegraph_diff": cpu_diff("""
        select list_reduce(list_concat([''], prefix), lambda x, y: md5(x || '|' || y)) as node_id,
               list_reduce(list_concat([''], prefix[1 : len(prefix) - 1]), lambda x, y: md5(x || '|' || y)) as parent_id,
               cast(len(prefix) - 1 as integer) as depth, prefix[-1] as name,
               cast(sum(v) as bigint) as cumulative, cast(sum(d) as bigint) as cumulative_diff,
               cast(sum(case when own then v else 0 end) as bigint) as flat,
               cast(sum(case when own then d else 0 end) as bigint) as flat_diff
        from (select path[1:i] as prefix, i = len(path) as own, v, d
              from (select path, v, d, unnest(generate_series(1, len(path))) as i
                    from (select list_reverse(names) as path, v, d from compared)))
        group by prefix"""),
    "top_places": cpu_diff(f"""
        select f.build_id as build_id, f.binary as "binary", f.name as "function", f.file as file,
               cast(sum(v) as bigint) as cumulative, cast(sum(d) as bigint) as cumulative_diff,
               cast(sum(case when f = places[1] then v else 0 end) as bigint) as flat,
               cast(sum(case when f = places[1] then d else 0 end) as bigint) as flat_diff
        from (select places, v, d, unnest(list_distinct(places)) as f from (select {PLACES} as places, v, d from compared)) group by f"""),
    "flamegraph_places": cpu_diff(f""",
        paths as (select list_reverse({PLACES}) as path, v, d from compared),"""
        + place_nodes("""cast(sum(v) as bigint) as cumulative, cast(sum(d) as bigint) as cumulative_diff,
               cast(sum(case when own then v else 0 end) as bigint) as flat,
               cast(sum(case when own then d else 0 end) as bigint) as flat_diff""")),
    "flamegraph_group_by_map_label": with_samples(f""",
        teams as (
          select stack, value, sample_type,
                 case when month(epoch_ms(timestamp)) = 12 then '' when month(epoch_ms(timestamp)) % 2 = 1 then 'odd' else 'even' end as team
          from samples where name = 'process_cpu'),
        paths as (
          select list_concat([{{'build_id': '', 'binary': '', 'name': team, 'file': ''}}, {{'build_id': '', 'binary': '', 'name': sample_type, 'file': ''}}],
                             list_reverse({PLACES})) as path, value as v, 0 as d from teams),"""
        + place_nodes("""cast(sum(v) as bigint) as cumulative, cast(sum(case when own then v else 0 end) as bigint) as flat""")),
    "callgraph_places": place_edges("stacks as (select id, v, d, list_transform(names, lambda x, i: {'pos': i, 'name': x}) as frames from numbered)"),
    "callgraph_places_trimmed": place_edges("""kept as (
          select f from (select v, unnest(list_distinct(names)) as f from numbered)
          group by 1 having cast(sum(v) as double) * 100 >= 4.0 * (select sum(v) from numbered)),
        exploded as (select id, v, d, unnest(names) as f, generate_subscripts(names, 1) as pos from numbered),
        stacks as (
          select id, v, d, list({'pos': pos, 'name': f} order by pos) as frames
          from exploded where f in (select f from kept) group by 1, 2, 3)"""),
    "source_lines_diff": cpu_diff("""
        select p.build as build_id, p.src as filename, p.line as line,
               cast(sum(v) as bigint) as cumulative, cast(sum(d) as bigint) as cumulative_diff,
               cast(sum(case when p = stack[1] then v else 0 end) as bigint) as flat,
               cast(sum(case when p = stack[1] then d else 0 end) as bigint) as flat_diff
        from (select v, d, stack, unnest(list_distinct(stack)) as p
              from (select v, d, list_transform(stack, lambda f: {'build': f.build, 'src': f.src, 'line': f.line}) as stack from compared))
        group by 1, 2, 3"""),
    "source_lines": with_samples("""
        select build_id, filename, line, cast(sum(value) as bigint) as cumulative,
               cast(sum(case when own then value else 0 end) as bigint) as flat
        from (
          select value, p.build as build_id, p.src as filename, p.line as line,
                 p.build = stack[1].build and p.src = stack[1].src and p.line = stack[1].line as own
          from (select stack, value, unnest(list_distinct(
                  list_transform(stack, lambda f: {'build': f.build, 'src': f.src, 'line': f.line}))) as p
                from samples))
        group by 1, 2, 3"""),
}


def build_of(key: str) -> str:
    return f"case when {key} % 3 = 0 then 'blibc' else 'b' || ({key} % 11) end"


def low_of(key: str) -> str:
    return f"(case when {key} % 3 <> 0 and {key} % 11 = 7 then -2130706432 else 0 end + {key} * 4096)"


FUNCTIONS = f"""
functions as (
  select p_partkey, p_size, p_type, {build_of('p_partkey')} as build_id, {low_of('p_partkey')} as low,
         replace(p_name, ' ', '_') as plain,
         case when p_size < 10 then '_Z' || p_partkey || 'v'
              when p_size < 20 then replace(p_name, ' ', '_')
              when p_size < 35 then '_ZN' || length(split_part(p_name, ' ', 1)) || split_part(p_name, ' ', 1)
                   || length(split_part(p_name, ' ', 2)) || split_part(p_name, ' ', 2)
                   || '17h' || substr(md5(cast(p_partkey as varchar)), 1, 16) || 'E'
              else case when p_size < 40 then '_RNvCs' else '_RINvCs' end || p_partkey || '_'
                   || length(split_part(p_name, ' ', 1)) || split_part(p_name, ' ', 1)
                   || length(split_part(p_name, ' ', 2)) || split_part(p_name, ' ', 2)
                   || case when p_size < 40 then '' else 'NtB2_4ItemRShE' end end as system_name,
         case when p_size < 10 then 'cpp::' || lower(p_type) || '()'
              when p_size < 20 then replace(p_name, ' ', '_')
              when p_size < 40 then replace(p_name, ' ', '::')
              else replace(p_name, ' ', '::') || '::<' || split_part(p_name, ' ', 1) || '::Item, &[u8]>' end as readable
  from part),
names as (
  select system_name, min(readable) as readable from functions group by 1),
all_symbols as (
  select 1 as rank, build_id, low + p_size * 32 as address, system_name as name from functions
  union all
  select 2, build_id, case when p_size > 25 then low + p_size * 32 else low + 2048 end, 'dyn_' || plain from functions
  union all
  select 3, build_id, low + 3000 + p_size, plain || '@plt' from functions),
symbols as (
  select build_id, address, name from (
    select *, row_number() over (partition by build_id, address order by rank, name) as rn from all_symbols)
  where rn = 1),
probes as (
  select distinct {build_of('l_partkey')} as build_id, {low_of('l_partkey')} + l_linenumber * 500 as address
  from lineitem),
ranges as (
  select build_id, low + (p_size % 3 - depth) * 256 as low, low + 4096 - (p_size % 3 - depth) * 512 as high,
         depth, p_size + depth as line, system_name,
         case when depth = 1 and p_size = 13 then null else lower(p_type) || '.rs' end as filename
  from (select *, unnest(generate_series(0, p_size % 3)) as depth from functions)
  union all
  select build_id, case when build_id = 'b7' then -2130706432 else 0 end,
         case when build_id = 'b7' then -2130706432 else 0 end + (max(p_partkey) + 1) * 4096,
         9, 1, 'unit_' || build_id, 'unit.c'
  from functions group by build_id)
"""

ASOF = """
select p.build_id, p.address, s.address as symbol_address, s.name as symbol
from {probes} p asof left join symbols s on p.build_id = s.build_id and p.address >= s.address
"""

RANGED = """
select p.build_id, p.address,
       string_agg(coalesce(n.readable, r.system_name) || ':' || r.filename || ':' || r.line, ';' order by depth) as lines
from {probes} p join ranges r on p.build_id = r.build_id and r.low <= p.address and p.address < r.high
left join names n on n.system_name = r.system_name
where r.filename is not null
group by 1, 2
"""

RAW = f"""
raw as (
  select {build_of('l_partkey')} as build_id, {low_of('l_partkey')} + l_linenumber * 500 as address,
         l_suppkey * 12288 + 2500 as library, cast(l_quantity as bigint) as value
  from lineitem),
frames as (
  select build_id, address from raw union select 'blibc', library from raw),
shifted as (
  select build_id, address as file_address,
         address + case when build_id in ('b0', 'b1', 'b7') then 0 else 4194304 end as address
  from frames),
by_symbol as ({ASOF.format(probes="frames")}),
by_range as ({RANGED.format(probes="frames")}),
resolved as (
  select f.build_id, f.address, f.file_address,
         case f.build_id
           when 'b3' then 'error: not a valid ELF file'
           when 'b4' then 'error: no usable debug information'
           when 'b5' then 'error: no quality'
           when 'b6' then 'error: not uploaded yet'
           when 'b8' then 'error: no resolver'
           when 'b9' then 'error: debug information not found'
           else case when l.lines is null and s.symbol is null then 'error: no symbol' else 'ok' end
         end as status,
         case when f.build_id in ('b0', 'b7') then l.lines
              when f.build_id in ('b1', 'b2', 'b10', 'blibc') then
                case when s.symbol like '%@plt' then coalesce(n.readable, replace(s.symbol, '@plt', '')) || '@plt'
                     else coalesce(n.readable, s.symbol) end || ':?:0'
         end as lines
  from shifted f
  left join by_range l on l.build_id = f.build_id and l.address = f.file_address and f.build_id in ('b0', 'b7')
  left join by_symbol s on s.build_id = f.build_id and s.address = f.file_address
    and f.build_id in ('b1', 'b2', 'b10', 'blibc')
  left join names n on n.system_name = replace(s.symbol, '@plt', ''))
"""

NAMES_OF_LINES = "array_to_string(list_transform(string_split({x}, ';'), lambda y: regexp_replace(y, ':[^:]*:[^:]*$', '')), ';')"

SYMBOL_ORACLES: dict[str, str] = {
    "symbol_table": f"with {FUNCTIONS} select * from symbols",
    "symbol_asof": f"with {FUNCTIONS} {ASOF.format(probes='probes')}",
    "line_lookup": f"with {FUNCTIONS} {RANGED.format(probes='probes')}",
    "resolver_choice": f"""with {FUNCTIONS} select distinct build_id,
        case when build_id = 'b3' then 'error: not a valid ELF file'
             when build_id = 'b4' then 'error: no usable debug information'
             when build_id = 'b6' then 'error: not uploaded yet'
             when build_id = 'b5' then 'error: no quality'
             when build_id in ('b0', 'b7') then 'line ranges'
             when build_id = 'b8' then 'error: no resolver' else 'symbols' end as resolver
        from functions where build_id <> 'b9'""",
    "demangle_names": f"""with {FUNCTIONS} select p_partkey, system_name,
        case when p_size > 45 then 'given' else readable end as name from functions""",
    "unresolved_addresses": f"""with {FUNCTIONS}, {RAW} select distinct build_id, cast(4194304 as bigint) as mapping_start,
        cast(70368744177664 as bigint) as mapping_limit, cast(0 as bigint) as mapping_offset, address from shifted""",
    "resolved_addresses": f"with {FUNCTIONS}, {RAW} select build_id, address, status, lines from resolved",
    "symbolized_stacks": f"""with {FUNCTIONS}, {RAW},
        profile as (select build_id, address, library, sum(value) as value from raw group by 1, 2, 3)
        select coalesce({NAMES_OF_LINES.format(x='a.lines')},
                        '0x' || lower(to_hex(cast(a.address as bigint)))) || ';' ||
               coalesce({NAMES_OF_LINES.format(x='b.lines')},
                        '0x' || lower(to_hex(cast(b.address as bigint)))) || ';main' as stack,
               cast(p.value as bigint) as value
        from profile p
        join resolved a on a.build_id = p.build_id and a.file_address = p.address
        join resolved b on b.build_id = 'blibc' and b.file_address = p.library""",
    "normalize_address": """
with segments as (
  select 's' || s_suppkey as build_id, s_suppkey % 3 as kind, u, b, k,
         case k when 0 then 0 when 1 then u else u + 2048 end as off,
         b + case k when 0 then 0 when 1 then u + 4096 else u + 10240 end as vaddr,
         case k when 0 then u - 100 when 1 then 8192 else 4096 end as memsz
  from (select *, 4096 * (1 + s_nationkey % 4) as u,
               case when s_suppkey % 3 = 0 then 4194304 else 0 end as b,
               unnest([0, 1, 2]) as k
        from supplier where s_acctbal >= 0)),
probes as (
  select distinct 's' || l_suppkey as build_id,
         case when l_linenumber = 6 then 0 else m end as s,
         case when l_linenumber = 7 then 4194304 else m + 12288 end as e,
         case when l_linenumber % 3 = 0 then 0 else 4096 * (l_linenumber % 4) end as o,
         m + l_linenumber * 1500 as a
  from (select *, 4194304 + (l_partkey % 16) * 65536 as m from lineitem)),
candidates as (
  select p.*, g.kind, g.off, g.vaddr, g.memsz,
         g.off <= a - s + o and a - s + o < g.off + g.memsz as hit
  from probes p join segments g on p.build_id = g.build_id
  where s < e and o < g.off + g.memsz and g.off < o + (e - s)
    and not (o < case when g.off > g.vaddr % 4096 then g.off - g.vaddr % 4096 else 0 end)
    and not (o > g.off and g.off + g.memsz < o + 4096 and o + (e - s) >= g.off + g.memsz + 4096)),
counted as (
  select build_id, s, e, o, a, count(*) as n, sum(case when hit then 1 else 0 end) as hits,
         max(kind) as kind,
         case when count(*) = 1 then max(off) else max(case when hit then off end) end as off,
         case when count(*) = 1 then max(vaddr) else max(case when hit then vaddr end) end as vaddr
  from candidates group by all),
judged as (
  select p.*, c.kind, c.off, c.vaddr,
         case when p.s >= p.e then 'invalid mapping'
              when p.build_id not in (select build_id from segments) then 'ok'
              when c.n is null then 'no program header matches mapping'
              when c.n > 1 and c.hits = 0 then 'no program header matches file offset'
              when c.n > 1 and c.hits > 1 then 'second program header matches file offset'
              when c.kind = 1 and p.o <> 0 then 'relocatable file with mapping offset'
              else 'ok' end as status
  from probes p left join counted c on p.build_id = c.build_id and p.s = c.s and p.e = c.e and p.o = c.o and p.a = c.a)
select build_id, cast(s as bigint) as mapping_start, cast(e as bigint) as mapping_limit,
       cast(o as bigint) as mapping_offset, cast(a as bigint) as address, status,
       cast(case when status <> 'ok' then null
            when kind is null then a
            when kind = 1 then a - (vaddr - off + s)
            else a - (s - o + off - vaddr) end as bigint) as normalized
from judged
""",
}

TYPE_KEY = "case {t} when 1 then 'executable' when 2 then 'sources' else 'debuginfo' end"

CATALOG = f"""
catalog as (
  select * from (
    select 'bid' || o_custkey as build_id, {TYPE_KEY.format(t='(o_orderkey % 3)')} as type_key,
           case when o_orderstatus = 'P' then 2 else 1 end as source,
           case when o_orderstatus <> 'P' then 'u' || o_orderkey end as upload_id,
           case when o_orderstatus <> 'P' then 'h' || (o_orderkey % 5) end as hash,
           case when o_orderstatus <> 'P' then o_orderdate end as started_at,
           cast(null as timestamp) as finished_at,
           case when o_orderstatus = 'P' then null
                when o_orderpriority in ('1-URGENT', '2-HIGH') then 1 else 2 end as state,
           case when o_orderkey % 4 <> 0 then o_orderkey % 4 = 1 end as not_valid_elf,
           row_number() over (partition by o_custkey, o_orderkey % 3 order by o_orderdate desc, o_orderkey desc) as rn
    from orders) where rn = 1),
requests as (
  select 'bid' || c_custkey as build_id, cast(c_custkey % 3 as integer) as type,
         {TYPE_KEY.format(t='(c_custkey % 3)')} as type_key,
         case when c_custkey % 7 = 0 then '' else 'h' || (c_custkey % 5) end as hash,
         c_nationkey % 2 = 0 as force, c_custkey % 4 as build_id_type,
         case when c_acctbal < 0 then 0 when c_acctbal > 9000 then 2000000000 else 1000 end as size
  from customer),
index as (
  select 'srv' || (c_nationkey % 2) as server, 'bid' || c_custkey as build_id from customer where c_acctbal > 2000
  union
  select 'srv0', 'bid' || c_custkey from customer where c_acctbal > 6000)
"""


def decided(documented: bool) -> str:
    """Reason codes by cases; ``good`` marks rows that take the "already exists" answers."""
    good = (
        "not coalesce(c.not_valid_elf, false)" if documented else "(c.not_valid_elf is null or c.not_valid_elf)"
    )
    fod = (
        "case when c.not_valid_elf then 'DebuginfodInvalid' else 'DebuginfodSource' end"
        if documented
        else "case when c.not_valid_elf = false then 'DebuginfodInvalid' else 'DebuginfodSource' end"
    )
    should_fod = "reason = 'DebuginfodInvalid'" if documented else "true"
    return f"""
decided as (
  select *, case
      when reason in ('InDebuginfod', 'UploadInProgress', 'AlreadyExists', 'DebuginfoEqual') then false
      when reason in ('DebuginfodSource', 'DebuginfodInvalid') then {should_fod}
      else true end as should_initiate
  from (
    select r.*, case
        when length(r.build_id) <= 2 then null
        when c.build_id is null then
          case when r.build_id_type in (0, 1) and r.build_id in (select build_id from index)
               then 'InDebuginfod' else 'FirstTimeSeen' end
        when c.source = 2 then {fod}
        when c.state = 1 then
          case when c.started_at + interval 17 minute < timestamp '2001-06-01' then 'UploadStale'
               else 'UploadInProgress' end
        when {good} then case when r.force then 'AlreadyExistsButForced' else 'AlreadyExists' end
        when r.hash = '' then 'DebuginfoInvalid'
        when r.hash = c.hash then 'DebuginfoEqual'
        else 'DebuginfoNotEqual' end as reason
    from requests r left join catalog c on r.build_id = c.build_id and r.type_key = c.type_key))
"""


CHUNKS = """
chunks as (
  select upload_id, seq, substring(text, seq * 500 + 1, 500) as chunk
  from (select 'doc' || doc_id as upload_id, text,
               unnest(generate_series(0, cast((length(text) - 1) // 500 as integer))) as seq
        from documents))
"""

EVENTS = f"""
events as (
  select 'bid' || o_custkey as build_id, {TYPE_KEY.format(t='(o_orderkey % 3)')} as type_key, o_orderkey as seq,
         case o_orderpriority when '1-URGENT' then 'uploading' when '3-MEDIUM' then 'quality'
              when '4-NOT SPECIFIED' then 'debuginfod' else 'uploaded' end as kind,
         'u' || (o_orderkey % 2) as upload_id, 'h' || (o_orderkey % 5) as hash, o_orderdate as at,
         o_orderkey % 4 = 1 as not_valid_elf
  from orders),
seen as (
  select *, max(case when kind in ('uploading', 'debuginfod') then seq end)
              over (partition by build_id, type_key order by seq) as reset_seq,
            max(case when kind in ('uploading', 'debuginfod') then seq end)
              over (partition by build_id, type_key) as last_reset
  from events)
"""

OUTCOMES = """select s.build_id, s.type_key, s.seq, s.kind, case
          when s.kind in ('uploading', 'debuginfod') then 'ok'
          when s.reset_seq is null then 'debuginfo not found'
          when s.kind = 'quality' then 'ok'
          when r.kind = 'debuginfod' then 'debuginfo is not in uploading state'
          when r.upload_id <> s.upload_id then 'mismatched upload id'
          else 'ok' end as status
        from seen s left join events r
          on r.build_id = s.build_id and r.type_key = s.type_key and r.seq = s.reset_seq"""

TIMED = EVENTS.replace(
    "o_orderkey as seq",
    "date_diff('day', date '1970-01-01', cast(o_orderdate as date)) * 100000000000 + o_orderkey as seq",
)

REPEATED = f"""requests as (
  select build_id, t as type, {TYPE_KEY.format(t='t')} as type_key, hash, force, build_id_type,
         case when size = 1000 then 1000 + t else size end as size
  from (select *, unnest([0, 3, 1]) as t from single)),
"""

CATALOG_ORACLES: dict[str, str] = {
    "catalog_latest": f"with {CATALOG} select * exclude (rn) from catalog",
    "upload_decision": f"with {CATALOG}, {decided(False)} select build_id, type, should_initiate, reason from decided",
    "upload_decision_documented": f"with {CATALOG}, {decided(True)} select build_id, type, should_initiate, reason from decided",
    "initiate_checks": f"""with {CATALOG}, {decided(False)}, judged as (
        select build_id, type, case
          when hash = '' then 'invalid argument: hash is empty'
          when size = 0 then 'invalid argument: size is zero'
          when reason = 'DebuginfoEqual' then 'already exists'
          when not should_initiate then 'failed precondition'
          when size > 1000000000 then 'invalid argument: too large'
          else 'ok' end as status from decided)
        select *, status = 'ok' as initiated from judged""",
    "initiate_same_key": f"""with {CATALOG.replace("requests as (", "single as (").replace("index as (", REPEATED + "index as (")}, {decided(False)}, judged as (
        select *, case
          when hash = '' then 'invalid argument: hash is empty'
          when size = 0 then 'invalid argument: size is zero'
          when reason = 'DebuginfoEqual' then 'already exists'
          when not should_initiate then 'failed precondition'
          when size > 1000000000 then 'invalid argument: too large'
          else 'ok' end as first_status from decided),
        turns as (select *, row_number() over (partition by build_id, type_key, first_status order by hash, size, type) as turn from judged)
        select build_id, type, hash, size, case when first_status = 'ok' and turn > 1 then 'failed precondition' else first_status end as status,
               first_status = 'ok' and turn = 1 as initiated from turns""",
    "server_availability": f"""with {CATALOG}
        select build_id, string_agg(server, ',' order by server) as servers from index group by 1""",
    "source_routing": f"""with {CATALOG}
        select build_id, type_key, case when source = 2 then 'debuginfod'
          when upload_id in (select 'u' || l_orderkey from lineitem) then 'object'
          else 'error: object not found' end as route from catalog""",
    "chunk_reassembly": f"""with {CHUNKS}, placed as (
        select upload_id, seq, chunk, octet_length(encode(chunk)) as size, cast(coalesce(sum(octet_length(encode(chunk))) over (
                 partition by upload_id order by seq rows between unbounded preceding and 1 preceding), 0) as bigint) as pos
        from chunks),
        parts as (
          select upload_id, min(pos) as "offset", sum(size) as size, count(*) as n, sha256(string_agg(chunk, '' order by seq)) as digest
          from placed group by upload_id, pos // 4000)
        select upload_id, cast(sum(size) as bigint) as size, cast(sum(n) as bigint) as chunks, 'ok' as status,
               string_agg("offset" || ':' || digest, ',' order by "offset") as parts
        from parts group by 1""",
    "upload_streams": f"""with {CATALOG}, headers as (
        select o_orderkey as stream_id, case when o_orderkey % 11 = 3 then null when o_orderkey % 13 = 4 then 'chunk' else 'info' end as kind,
               case when o_orderkey % 17 = 5 then 'b1' when o_orderkey % 19 = 6 then 'none' || o_custkey else 'bid' || o_custkey end as build_id,
               case when o_orderkey % 23 = 7 then 9 else o_orderkey % 3 end as type, 'u' || o_orderkey as upload_id
        from orders),
        messages as (
          select l_orderkey as stream_id, l_linenumber as seq,
                 case when l_linenumber <> 6 then l_orderkey || ':line:' || l_linenumber end as chunk
          from lineitem),
        keyed as (select *, {TYPE_KEY.format(t='type')} as type_key from headers),
        judged as (
          select h.stream_id, h.build_id, h.type_key, h.upload_id, case
            when kind is null then 'invalid argument: Missing data'
            when kind <> 'info' then 'invalid argument: Invalid data type.'
            when type not in (0, 1, 2) then 'invalid argument: Invalid debuginfo type.'
            when length(h.build_id) <= 2 then 'invalid argument: unexpectedly short input'
            when c.build_id is null then 'failed precondition: metadata not found, this indicates that the upload was not previously initiated'
            when c.upload_id is null then 'invalid argument: metadata not found, this indicates that the upload was not previously initiated'
            when c.upload_id <> h.upload_id then 'failed precondition: upload metadata not found, this indicates that the upload was not previously initiated'
            when exists (select 1 from messages m where m.stream_id = h.stream_id and m.chunk is null) then 'invalid argument: provided no value or invalid data'
            else 'ok' end as status
          from keyed h left join catalog c on h.build_id = c.build_id and h.type_key = c.type_key),
        placed as (
          select stream_id, seq, chunk, octet_length(encode(chunk)) as size, cast(coalesce(sum(octet_length(encode(chunk))) over (
                   partition by stream_id order by seq rows between unbounded preceding and 1 preceding), 0) as bigint) as pos
          from messages),
        parts as (
          select stream_id, min(pos) as "offset", sum(size) as size, count(*) as n, sha256(string_agg(chunk, '' order by seq)) as digest
          from placed group by stream_id, pos // 40),
        whole as (
          select stream_id, cast(sum(size) as bigint) as size, cast(sum(n) as bigint) as chunks,
                 string_agg("offset" || ':' || digest, ',' order by "offset") as parts
          from parts group by 1)
        select j.*, case when status = 'ok' then coalesce(size, 0) end as size, case when status = 'ok' then coalesce(chunks, 0) end as chunks,
               case when status = 'ok' then parts end as parts
        from judged j left join whole w on j.stream_id = w.stream_id""",
    "upload_parts": f"""with {CHUNKS}, placed as (
        select upload_id, seq, chunk, cast(coalesce(sum(octet_length(encode(chunk))) over (
                 partition by upload_id order by seq rows between unbounded preceding and 1 preceding), 0) as bigint) as pos
        from chunks)
        select upload_id, pos // 1500 as part, min(pos) as "offset", sha256(string_agg(chunk, '' order by seq)) as digest
        from placed group by 1, 2""",
    "chunk_offsets": f"""with {CHUNKS}
        select upload_id, cast(seq as integer) as seq, octet_length(encode(chunk)) as size,
               cast(coalesce(sum(octet_length(encode(chunk))) over (
                 partition by upload_id order by seq rows between unbounded preceding and 1 preceding), 0) as bigint)
                 as "offset",
               md5(chunk) as digest
        from chunks""",
    "upload_lifecycle": f"""with {EVENTS}
        select r.build_id, r.type_key, case when r.kind = 'uploading' then 1 else 2 end as source,
               case when r.kind = 'uploading' then r.upload_id end as upload_id,
               case when r.kind = 'uploading' then r.hash end as hash,
               case when r.kind = 'uploading' then r.at end as started_at,
               (select arg_max(e.at, e.seq) from seen e where e.build_id = r.build_id and e.type_key = r.type_key
                  and e.seq > r.seq and e.kind = 'uploaded' and e.upload_id = r.upload_id
                  and r.kind = 'uploading') as finished_at,
               case when r.kind = 'uploading' then
                 case when exists (select 1 from seen e where e.build_id = r.build_id and e.type_key = r.type_key
                   and e.seq > r.seq and e.kind = 'uploaded' and e.upload_id = r.upload_id) then 2 else 1 end
               end as state,
               (select arg_max(e.not_valid_elf, e.seq) from seen e where e.build_id = r.build_id
                  and e.type_key = r.type_key and e.seq > r.seq and e.kind = 'quality') as not_valid_elf
        from seen r where r.seq = r.last_reset""",
    "lifecycle_outcomes": f"with {EVENTS} {OUTCOMES}",
    "stream_outcomes": f"""with {TIMED} {OUTCOMES}
        union all
        select e.build_id, e.type_key, e.seq, 'stale', 'upload is stale' from events e
        where e.kind = 'uploading' and e.at + interval 17 minutes < (select max(m.at) from events m)
          and not exists (select 1 from events f where f.build_id = e.build_id and f.type_key = e.type_key and f.seq > e.seq
            and f.at <= e.at + interval 17 minutes
            and (f.kind in ('uploading', 'debuginfod') or (f.kind = 'uploaded' and f.upload_id = e.upload_id)))""",
}

PPROF = """
heads as (
  select 'p' || o_orderkey as profile_id, o_orderkey, o_custkey % 40 as broken, epoch_ms(o_orderdate) as ms,
         o_orderstatus, o_orderpriority,
         (select count(*) from lineitem where l_orderkey = o_orderkey) as n
  from orders),
numbered as (
  select *, row_number() over (
      partition by l_orderkey
      order by l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax,
               l_returnflag, l_linestatus, l_shipdate) - 1 as pos
  from lineitem),
entries as (
  select h.*, l.pos, l.l_partkey, l.l_linenumber, cast(l.l_quantity as bigint) as qty, l.l_discount,
         l.l_returnflag, l.l_linestatus, p.p_name, p.p_type, p.p_size
  from numbered l join heads h on l.l_orderkey = h.o_orderkey join part p on l.l_partkey = p.p_partkey),
good as (select * from entries where broken not between 1 and 17),
good_heads as (select * from heads where not (broken between 1 and 17)
    or (n = 0 and broken in (6, 7, 8, 9, 10, 11, 12, 13, 14, 15, 16, 17))),
frames as (
  select profile_id, pos,
         (l_partkey * 4096) || ',' ||
         case when l_returnflag = 'R' then '0,0,0,,' else '4194304,8388608,0,/bin/app,buildapp' end || ',' ||
         case when l_linenumber = 7 then '7||||7'
              else l_linenumber || '|' || p_name || '|' || case when p_size < 10 then '' else '_' || p_name end
                   || '|' || p_type || '|' || l_linenumber end ||
         case when qty > 25 then
           (select '&99|' || f.p_name || '|' || case when f.p_size < 10 then '' else '_' || f.p_name end
                   || '|' || f.p_type || '|99'
            from good f where f.profile_id = g.profile_id and f.pos = 0)
         else '' end as frame
  from good g),
stacks as (
  select g.profile_id, g.pos,
         a.frame || case when g.pos > 0 then ';' || b.frame else '' end || ';' || c.frame as stack
  from good g
  join frames a on a.profile_id = g.profile_id and a.pos = g.pos
  left join frames b on b.profile_id = g.profile_id and b.pos = g.pos - 1
  join frames c on c.profile_id = g.profile_id and c.pos = 0
  where g.l_discount <> 0),
values_of as (
  select profile_id, pos, 0 as type_no, qty as value from good where qty <> 0
  union all
  select profile_id, pos, 1, qty * 100 from good where l_returnflag <> 'N' and qty <> 0),
labels_of as (
  select profile_id, pos,
         'thread=' || case when l_linestatus = 'F' then o_orderstatus else o_orderpriority end as sample_labels,
         'size=' || case when qty <> 0 then qty else 5 end as num_labels
  from good),
series as (
  select profile_id, o_orderpriority, o_orderstatus,
         case o_orderkey % 50 when 0 then 'duplicate label' when 1 then 'missing __name__' end as error
  from heads)
"""


def rule(name: str, condition: str, source: str = "entries") -> str:
    return f"select distinct profile_id, '{name}' as rule from {source} where {condition}"


NORMALIZED = f"""with {PPROF}
select 'process_cpu' as name, h.ms as timestamp, cast(10000000000 as bigint) as duration,
       cast(100 as bigint) as period,
       case when h.o_orderstatus = 'P' then '' else 'cpu' end as period_type,
       case when h.o_orderstatus = 'P' then '' else 'nanoseconds' end as period_unit,
       case v.type_no when 0 then 'samples' else 'alloc' end as sample_type,
       case v.type_no when 0 then 'count' else 'bytes' end as sample_unit,
       v.value, s.stack, h.o_orderpriority as node,
       'node=' || h.o_orderpriority || ',team=' || h.o_orderstatus as series_labels,
       l.sample_labels, l.num_labels
from values_of v
join heads h on h.profile_id = v.profile_id
join series r on r.profile_id = v.profile_id and r.error is null
join labels_of l on l.profile_id = v.profile_id and l.pos = v.pos
left join stacks s on s.profile_id = v.profile_id and s.pos = v.pos
"""

BROKEN = " union all ".join(
    [
        *[rule(f"V{i}", f"broken = {i}", "heads") for i in (1, 2, 3, 4, 5)],
        *[rule(f"V{i}", f"broken = {i}") for i in (6, 7, 8, 9, 10, 11, 12, 13, 15, 16, 17)],
        rule("V14", "broken in (13, 14)"),
    ]
)

REJECTED = f"""with {PPROF},
broken_rules as ({BROKEN}),
reasons(rule, reason) as (values {", ".join(f"('{k}', '{v}')" for k, v in REASONS.items())}),
damaged as (select profile_id from heads where o_orderkey % 50 = 3)
select profile_id, 'blob' as level, 'unreadable' as rule, 'not gzip' as reason from damaged
union all
select profile_id, 'series', replace(error, ' ', '_'), error from series where error is not null
union all
select profile_id, 'profile', rule, reason from broken_rules join reasons using (rule)
where profile_id not in (select profile_id from damaged)
"""

PPROF_ORACLES: dict[str, str] = {
    "ingest_rejects": REJECTED,
    "series_labels": f"""with {PPROF}
        select profile_id, case when error is null then 'process_cpu' end as name,
               case when error is null then 'node=' || o_orderpriority || ',team=' || o_orderstatus end as labels,
               error from series""",
    "pprof_violations": f"with {PPROF} {BROKEN}",
    "sample_explode": f"""with {PPROF} select profile_id, cast(pos as bigint) as sample_no,
        cast(type_no as bigint) as type_no, value from values_of""",
    "profile_meta": f"""with {PPROF}
        select profile_id, cast(t as bigint) as type_no, ms as timestamp, cast(10000000000 as bigint) as duration,
               cast(100 as bigint) as period,
               case t when 0 then 'samples' else 'alloc' end as sample_type,
               case t when 0 then 'count' else 'bytes' end as sample_unit,
               case when o_orderstatus = 'P' then '' else 'cpu' end as period_type,
               case when o_orderstatus = 'P' then '' else 'nanoseconds' end as period_unit
        from (select *, unnest([0, 1]) as t from good_heads where broken <> 13)""",
    "sample_labels": f"with {PPROF} select profile_id, cast(pos as bigint) as sample_no, sample_labels, num_labels from labels_of",
    "label_name_collection": f"""with {PPROF}
        select profile_id, unnest(['node', 'team']) as label_name from series where error is null
        union select profile_id, 'thread' from good""",
    "stack_denormalize": f"with {PPROF} select profile_id, cast(pos as bigint) as sample_no, stack from stacks",
    "label_pivot": f"with {PPROF} select profile_id, o_orderpriority as node from series where error is null",
    "normalized_samples": NORMALIZED,
    "pprof_roundtrip": NORMALIZED,
    "pprof_parts_roundtrip": NORMALIZED,
}

REPORTS = f"""
{SAMPLES},
rows_of as (
  select *, node || '/' || name as report_id from samples),
frames_of as (
  select distinct report_id, unnest(stack) as f from rows_of),
texts as (
  select report_id, unnest([f.fn, f.src, f.bin, f.build]) as text from frames_of
  union select report_id, unnest([sample_type, sample_unit, period_type, period_unit]) from rows_of
  union select report_id, '' from rows_of)
"""

SHOWN = """array_to_string(list_transform(stack, lambda f:
    f.addr || ',4194304,1099515822080,0,' || f.bin || ',' || f.build || ',' ||
    f.line || '|' || f.fn || '|' || f.fn || '|' || f.src || '|' || {start}), ';')"""


def created(entity: str, columns: str) -> str:
    """Entities of all stacks; those of returned items exist already."""
    return with_samples(f""",
        everything as (select distinct {entity}, min(case when pod is not null then 0 else 1 end) as fresh
                       from (select pod, unnest(stack) as f from samples) group by all)
        select {columns}, fresh = 1 as created from everything""")


LOCATIONS = f"""
locations as (select distinct build_id || ':' || address as id, address, build_id from shifted)
"""

REPORT_ORACLES: dict[str, str] = {
    "string_table": f"""with {REPORTS}
        select report_id, text, cast(row_number() over (
          partition by report_id order by text <> '', substr(md5(text), 1, 3), text) - 1 as bigint) as idx
        from (select distinct report_id, text from texts)""",
    "mapping_dedup": f"""with {REPORTS}
        select distinct report_id, f.bin as mapping_file, f.build as mapping_build_id,
               cast(4194304 as bigint) as mapping_start, cast(1099515822080 as bigint) as mapping_limit,
               cast(0 as bigint) as mapping_offset
        from (select report_id, {{'bin': min(f.bin), 'build': f.build}} as f from frames_of group by report_id, f.build)""",
    "function_dedup": f"""with {REPORTS}
        select distinct report_id, f.fn as name, f.fn as system_name, f.src as filename, cast(0 as bigint) as start_line
        from frames_of""",
    "location_dedup": f"""with {REPORTS}
        select report_id, cast(addr - 4194304 as bigint) as relative, cast(addr as bigint) as address, 1 as lines
        from (select distinct report_id, f.build as build, f.addr as addr from frames_of)""",
    "sample_merge": f"""with {REPORTS}
        select report_id, cast(len(place) as integer) as locations, cast(sum(value) as bigint) as value
        from (select report_id, value, list_transform(stack, lambda f: f.build || '/' || f.addr) as place from rows_of)
        group by report_id, place""",
    "report_export": f"""with {REPORTS}
        select report_id, (select max(timestamp) from rows_of m where m.report_id = r.report_id) as timestamp,
               sample_type, period_unit, {SHOWN.format(start='f.line')} as stack, cast(sum(value) as bigint) as value
        from rows_of r group by report_id, sample_type, period_unit, stack""",
    "get_or_create_stacks": with_samples(f"""
        select {SHOWN.format(start='0')} as stack, max(case when pod is not null then 1 else 0 end) = 0 as created
        from samples group by stack"""),
    "get_or_create_functions": created(
        "f.fn as fn, f.src as src",
        "cast(0 as bigint) as start_line, fn as name, fn as system_name, src as filename",
    ),
    "get_or_create_mappings": created(
        "f.bin as bin, f.build as build",
        "cast(4194304 as bigint) as start, cast(1099515822080 as bigint) as \"limit\", "
        "cast(0 as bigint) as \"offset\", bin as file, build as build_id",
    ),
    "get_or_create_locations": created(
        "f",
        "cast(f.addr as bigint) as address, f.bin as mapping_file, f.build as mapping_build_id, f.fn as \"function\"",
    ),
    "unknown_stacks": with_samples(f"""
        select {SHOWN.format(start='0')} as stack from samples group by stack
        having max(case when pod is not null then 1 else 0 end) = 0"""),
    "stored_functions": with_samples(""",
        everything as (select distinct f.fn as fn, f.src as src from (select unnest(stack) as f from samples))
        select cast(0 as bigint) as start_line, fn as name, fn as system_name, src as filename from everything"""),
    "stream_unknown_stacks": with_samples(f""",
        asked as (
          select stack, bool_or(early) as in_first, coalesce(bool_or(pod is not null) filter (early), false) as given_first,
                 bool_or(not early) as in_second, bool_or(pod is not null) as given
          from (select *, "timestamp" < 788918400000 as early from samples) group by stack)
        select cast(0 as bigint) as batch, {SHOWN.format(start='0')} as stack from asked where in_first and not given_first
        union all
        select cast(1 as bigint), {SHOWN.format(start='0')} from asked where in_second and not given"""),
    "unsymbolized_page": f"""with {FUNCTIONS}, {RAW}, {LOCATIONS}
        select id, cast(address as bigint) as address from locations where id > 'b2' order by id limit 500""",
    "location_lines": f"""with {FUNCTIONS}, {RAW}, {LOCATIONS},
        updates as (
          select 'blibc:' || (4194304 + l_suppkey * 12288 + 2500) as id, l_orderkey * 10 + l_linenumber as seq,
                 'f' || l_suppkey || ':late.c:' || l_linenumber as lines
          from lineitem)
        select id, coalesce((select arg_max(lines, seq) from updates u where u.id = l.id), '') as lines
        from locations l
        union all
        select 'bapp:4206592', 'main:main.c:1'""",
    "agents_status": """
        select case when user_id % 2 = 0 then 'node' || user_id else '10.0.0.' || user_id end as agent_id,
               arg_max(case when event_type = 'error' then 'push failed' else '' end, (ts, event_id)) as e,
               max(ts) as last_push,
               arg_max(cast(round(value * 100) as bigint), (ts, event_id)) as last_push_duration
        from events group by 1""",
    "targets_by_state": """
        select n_name as job, s_name as target, 'active' as state,
               case when s_acctbal < 0 then 'bad' when s_acctbal > 5000 then 'good' else 'unknown' end as health
        from supplier join nation on s_nationkey = n_nationkey where s_suppkey % 3 <> 0""",
    "target_jobs": """
        select n_name as job, count(*) as targets,
               count(*) filter (where s_acctbal >= 0 and s_acctbal <= 5000) as unknown,
               count(*) filter (where s_acctbal > 5000) as good,
               count(*) filter (where s_acctbal < 0) as bad
        from supplier join nation on s_nationkey = n_nationkey group by 1""",
    "store_scan": profile(
        """select stack, sum(value) as v from samples
           where timestamp >= epoch_ms(timestamp '1997-01-01') and timestamp < epoch_ms(timestamp '1999-01-01')
           group by 1"""
    ),
    "stream_ingest": NORMALIZED,
    "stream_rejects": REJECTED,
    "stream_range": """
        select event_type as type, epoch_ms(ts) - epoch_ms(ts) % 3600000 as bucket,
               cast(sum(cast(round(value * 100) as bigint)) as bigint) as value,
               sum(cast(round(value * 100) as bigint)) / 3600.0 as value_per_second
        from events group by 1, 2""",
    "stream_windows": """
        with samples as (
          select event_type as type, epoch_ms(ts) as at, epoch_ms(ts) - epoch_ms(ts) % 3600000 as bucket,
                 cast(round(value * 100) as bigint) as value, case when user_id % 10 < 7 then 1 when user_id % 10 < 9 then 2 else 3 end as load
          from events),
        marks as (
          select l.load, coalesce(max(s.at) - 7200000, 0) as mark
          from (values (1), (2), (3), (4)) l(load) left join samples s on s.load < l.load group by 1)
        select type, bucket, late, count(*) as samples, cast(sum(value) as bigint) as value
        from (select s.*, bucket + 3600000 <= m.mark as late from samples s join marks m using (load))
        where late or bucket + 3600000 <= (select mark from marks where load = 4) group by 1, 2, 3""",
    "stream_lifecycle": CATALOG_ORACLES["upload_lifecycle"],
}
REPORT_ORACLES["agents_status"] = (
    "select agent_id, nullif(e, '') as last_error, last_push, last_push_duration from ("
    + REPORT_ORACLES["agents_status"]
    + ")"
)

ORACLES: dict[str, str] = {
    **QUERY_ORACLES,
    **SYMBOL_ORACLES,
    **CATALOG_ORACLES,
    **PPROF_ORACLES,
    **REPORT_ORACLES,
}
