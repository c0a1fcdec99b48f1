"""Plain Python versions of the data problems, over whole small tables."""

from __future__ import annotations

import json
import math
from collections import defaultdict

import pyarrow.parquet as pq


def rows(folder, name, columns=None):
    return pq.read_table(f"{folder}/{name}.parquet", columns=columns).to_pylist()


def p1(folder):
    clusters = defaultdict(dict)
    for r in sorted(rows(folder, "topology_snapshots"), key=lambda r: -r["delivery_id"]):
        if r["slots"] is not None and len(r["slots"]) == r["slot_count"]:
            state = {("slot", str(i)): owner for i, owner in enumerate(r["slots"]) if owner}
            state |= {("shard", k): frozenset(v["members"] or []) for k, v in r["shards"] or []}
            clusters[r["cluster_id"]][r["version"]] = state
    out = set()
    for cluster, versions in clusters.items():
        order = sorted(versions)
        for a, b in zip(order, order[1:]):
            old, new = versions[a], versions[b]
            for key in old.keys() | new.keys():
                if old.get(key) != new.get(key):
                    out.add((cluster, a, b, *key, "added" if key not in old else "removed" if key not in new else "changed"))
    return out


def _report(x):
    while isinstance(x, str):
        x = json.loads(x)
    if isinstance(x, dict) and "batches" not in x:
        for k in ("report", "result"):
            if x.get(k) is not None:
                return _report(x[k])
    return x


def p2(folder):
    out = set()
    for r in rows(folder, "rebalance_reports"):
        try:
            x = _report(json.loads(r["body"] or "null"))
        except ValueError:
            continue
        batches = x.get("batches") if isinstance(x, dict) else None
        for i, b in enumerate(batches if isinstance(batches, list) else [batches]):
            if b is None:
                continue
            s = b.get("slots") or []
            leaves = [(j, str(v).strip()) for j, v in enumerate(s.split(",") if isinstance(s, str) else s) if v is not None]
            out |= {("batch_slot", r["report_id"], i, j, v) for j, v in leaves} or {("batch_slot", r["report_id"], i, -1, "")}
    for r in rows(folder, "slot_dumps", ["dump_id", "zsets"]):
        for i, z in enumerate(r["zsets"] or []):
            if z is not None:
                leaves = [(j, m["member"]) for j, m in enumerate(z["members"] or []) if m is not None and m["member"] is not None]
                out |= {("zset_member", r["dump_id"], i, j, m) for j, m in leaves} or {("zset_member", r["dump_id"], i, -1, "")}
    for r in rows(folder, "node_probes", ["probe_id", "shards"]):
        for i, s in enumerate(r["shards"] or []):
            if s is not None:
                out |= {("learner", r["probe_id"], i, j, n) for j, n in enumerate(s["learners"] or []) if n is not None}
    return out


def p3(folder):
    probes = {}
    for r in rows(folder, "node_probes", ["probe_id", "node_id", "probed_at", "reachable", "latency_ms"]):
        if r["reachable"] and r["latency_ms"] is not None and r["latency_ms"] >= 0:
            probes[r["probe_id"]] = r
    groups = defaultdict(list)
    for r in probes.values():
        groups[r["node_id"], r["probed_at"].strftime("%Y-%m-%d")].append(r["latency_ms"])
        groups[r["node_id"], r["probed_at"].strftime("%Y-%m")].append(r["latency_ms"])
    pick = {(k, p): sorted(v)[max(1, math.ceil(p * len(v) / 100)) - 1] for k, v in groups.items() for p in (50, 95)}
    return {(n, d, p) for ((n, d), p), v in pick.items() if len(d) == 10 and v >= 2 * pick[(n, d[:7]), p]}


def _value(data):
    if data is None:
        return None
    try:
        return ("json", json.loads(data))
    except ValueError:
        return ("bytes", data)


def p4(folder):
    commit = defaultdict(dict)
    for r in rows(folder, "shard_status"):
        if r["commit_index"] is not None:
            commit[r["shard_id"]][r["role"]] = max(r["commit_index"], commit[r["shard_id"]].get(r["role"], 0))
    logs = {name: {(r["shard"], r["idx"]): r for r in rows(folder, f"wal_{name}")} for name in ("leader", "follower")}
    out = {(s, 0, "commit_index") for s, c in commit.items() if c.get("leader") != c.get("follower")}
    for key in logs["leader"].keys() | logs["follower"].keys():
        c = commit[key[0]]
        if len(c) < 2 or key[1] > min(c.values()):
            continue
        a, b = logs["leader"].get(key), logs["follower"].get(key)
        if a is None or b is None:
            out.add((*key, "missing_in_leader" if a is None else "missing_in_follower"))
            continue
        out |= {(*key, f) for f in ("term", "cmd") if a[f] != b[f]}
        if _value(a["data"]) != _value(b["data"]):
            out.add((*key, "data"))
    return out


def p5(folder):
    shards = defaultdict(list)
    for r in rows(folder, "command_log"):
        shards[r["shard"]].append(r)
    out = set()
    for shard, log in shards.items():
        log.sort(key=lambda r: (r["idx"], -r["term"]))
        state, term = {}, -1
        for r in log:
            if r["term"] < term:
                continue
            term = r["term"]
            try:
                x = json.loads(r["data"] or b"null")
            except ValueError:
                continue
            if not isinstance(x, dict) or "cmd" not in x:
                continue
            a = x.get("args") or {}
            if x["cmd"] == "SET":
                state["string", a["key"], ""] = r["idx"]
            elif x["cmd"] == "ZADD":
                state["zset", a["key"], a["member"]] = r["idx"]
            elif x["cmd"] == "DEL":
                state.pop(("string", a["key"], ""), None)
                i = 1
                while str(i) in a:
                    state.pop(("string", a[str(i)], ""), None)
                    i += 1
            elif x["cmd"] == "ZREM":
                for k, m in a.items():
                    if k != "key":
                        state.pop(("zset", a["key"], m), None)
        out |= {(shard, *k, i) for k, i in state.items()}
    return out
