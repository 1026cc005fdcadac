"""Each row of the pipeline is judged by itself, with or without an id."""

import corpus_pipeline

from .fixtures import docs_frame, prose
from .test_pipeline import tables


def texts(frame):
    return sorted((r["doc_id"] or -1, r["text"] or "") for r in frame.collect())


def test_rows_of_any_id(spark, tmp_path):
    tables(spark, str(tmp_path))
    foul, clean = prose(1, 40) + " you are an idiot and a worthless moron. you are pathetic, you idiot.", prose(2, 60)
    kept = corpus_pipeline.not_toxic(spark, docs_frame(spark, [(None, foul), (7, foul), (7, clean), (None, clean)]), str(tmp_path))
    assert texts(kept) == [(-1, clean), (7, clean)]
    copies = [(None, clean), (None, clean), (5, foul), (5, foul), (None, foul), (4, prose(3, 50)), (4, prose(4, 50)), (9, None), (8, "")]
    assert texts(corpus_pipeline.one_of_each(spark, docs_frame(spark, copies), "")) == sorted([(-1, clean), (5, foul), (4, prose(3, 50)), (4, prose(4, 50)), (8, "")])
    item = "Anna has 12 apples and gives 5 apples to her friend Bob before walking 3 km to the old market square today"
    held = corpus_pipeline.not_contaminated(spark, docs_frame(spark, [(None, "so " + item), (3, "so " + item), (3, clean), (None, None)]), str(tmp_path))
    assert texts(held) == [(-1, ""), (3, clean)]
