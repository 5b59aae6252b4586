"""Print per-operator SQL metrics (time, rows) of the last executed plan of a DataFrame.

Usage inside a script: ``from tools.plan_metrics import run_and_report; run_and_report(df)``.
"""

from __future__ import annotations


def _walk(node, depth, out):
    name = node.nodeName()
    ms = node.metrics()
    it = ms.iterator()
    vals = {}
    while it.hasNext():
        kv = it.next()
        k, m = kv._1(), kv._2()
        if any(w in k for w in ("time", "duration", "rows", "spill", "size")):
            vals[k] = m.value()
    out.append(("  " * depth) + name + " " + ", ".join(f"{k}={v}" for k, v in vals.items() if v))
    # descend into adaptive / query stage wrappers
    for attr in ("finalPhysicalPlan", "plan"):
        try:
            inner = getattr(node, attr)()
            if inner is not None and inner is not node:
                _walk(inner, depth + 1, out)
                return
        except Exception:
            pass
    ch = node.children()
    for i in range(ch.size()):
        _walk(ch.apply(i), depth + 1, out)


def run_and_report(df, sink: str = "noop") -> str:
    qe = df.write.format(sink).mode("overwrite")
    qe.save()
    plan = df._jdf.queryExecution().executedPlan()
    out: list[str] = []
    _walk(plan, 0, out)
    return "\n".join(out)
