import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from bench import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return session()


@pytest.fixture(scope="session")
def fx_index(spark):
    """Five indexed pages of one space."""
    return spark.sql(
        """SELECT * FROM VALUES
        (0L,'100001','Parent Page 1',1,NULL,TIMESTAMP_NTZ'2025-10-01 10:00:00',TIMESTAMP_NTZ'2025-10-17 10:00:00',1,CAST(NULL AS INT),CAST(NULL AS TIMESTAMP_NTZ)),
        (1L,'100002','Parent Page 2',2,'100001',TIMESTAMP_NTZ'2025-10-02 10:00:00',TIMESTAMP_NTZ'2025-10-17 10:00:01',1,NULL,NULL),
        (2L,'100003','Parent Page 3',3,NULL,TIMESTAMP_NTZ'2025-10-03 10:00:00',TIMESTAMP_NTZ'2025-10-17 10:00:02',1,NULL,NULL),
        (3L,'100004','Child Page A',1,'100001',TIMESTAMP_NTZ'2025-10-04 10:00:00',TIMESTAMP_NTZ'2025-10-17 10:00:03',2,NULL,NULL),
        (4L,'100005','Child Page B',1,'100002',TIMESTAMP_NTZ'2025-10-05 10:00:00',TIMESTAMP_NTZ'2025-10-17 10:00:04',2,NULL,NULL)
        AS t(pos,id,title,version,parent_id,modified_at,indexed_at,page_number,downloaded_version,downloaded_at)"""
    )


@pytest.fixture(scope="session")
def fx_pages(spark):
    """Seven small pages."""
    rows = [
        (0, "200001", "Root Page", "<p>Root content</p>", 1, None),
        (1, "200002", "Child 1", "<p>Child 1 content</p>", 1, "200001"),
        (2, "200003", "Child 2", "<p>Child 2 content</p>", 1, "200001"),
        (3, "200004", "Grandchild", "<p>Grandchild content</p>", 1, "200002"),
        (4, "300001", "Single Page", "<p>Content</p>", 1, None),
        (5, "500002", "Queue Page", "<p>Queue content</p>", 1, None),
        (6, "600001", "Index Page", "<p>Index content</p>", 1, None),
    ]
    return spark.createDataFrame(rows, "pos long, id string, title string, html string, version int, parent_id string")


@pytest.fixture(scope="session")
def no_users(spark):
    return spark.createDataFrame([], "user_key string, username string, display_name string")
