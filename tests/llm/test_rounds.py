"""What star contraction costs when tables are small: tasks, beside right results."""

import random

from cellcnv.llm import simhash


def tasks_of(spark, name, run):
    context = spark.sparkContext
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 40)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    context.setJobGroup(name, name)
    try:
        out = [tuple(r) for r in run().collect()]
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    tracker = context.statusTracker()
    stages = {s for j in tracker.getJobIdsForGroup(name) for s in tracker.getJobInfo(j).stageIds}
    return out, sum(i.numCompletedTasks for i in map(tracker.getStageInfo, stages) if i)


def test_components_take_few_tasks(spark):
    rng = random.Random(2)
    nodes = [rng.randrange(-(1 << 62), 1 << 62) for _ in range(300)]
    links = [(nodes[k], nodes[k + 1]) for k in range(90)] + [(nodes[100], x) for x in nodes[101:200]]
    links += [(rng.choice(nodes[200:]), rng.choice(nodes[200:])) for _ in range(70)] + [(nodes[0], nodes[0])]
    rng.shuffle(links)
    root = {x: x for link in links for x in link if link[0] != link[1]}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        if a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    table = spark.createDataFrame(links, "a long, b long").repartition(6)
    got, tasks = tasks_of(spark, "components", lambda: simhash.components(table))
    assert sorted(got) == sorted((x, find(x)) for x in root)
    assert tasks < 900, tasks
