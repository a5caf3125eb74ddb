"""Rows that the operators of a query put out."""


def most_rows(df) -> int:
    """The most rows that an operator of df's executed plan puts out; runs df."""
    df._jdf.queryExecution().toRdd().count()
    found, left = [], [df._jdf.queryExecution().executedPlan()]
    while left:
        node = left.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            left.append(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            left.append(node.plan())
        else:
            metric = node.metrics().get("numOutputRows")
            if metric.isDefined():
                found.append(metric.get().value())
            children = node.children()
            left += [children.apply(i) for i in range(children.size())]
    return max(found)
