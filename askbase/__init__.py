"""askbase: question answering and knowledge-base curation as Spark plans.

Every operator is a ``DataFrame -> DataFrame`` function (or a column
expression) built from the DataFrame API, so Catalyst plans the whole
decision flow: keyword routing, the fuzzy match gate, classification,
response lookup and the unknown-question log.
"""

__version__ = "0.1.0"
