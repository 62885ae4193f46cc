"""quernstone: an analytics engine on Spark SQL.

Tables, queries and exchanges are declared with the DataFrame and SQL APIs;
Catalyst chooses the physical plan. Around that stand a small JSON plan
language, a relational model of how a plan breaks into fragments, tasks and
shuffle edges, an inspector of Spark's own plans, and a query lifecycle API.
"""
