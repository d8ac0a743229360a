"""All registered queries by name."""

from framewise.catalog import basics, models, prep, ranking, rates, reports

ALL = {
    **ranking.QUERIES,
    **rates.QUERIES,
    **prep.QUERIES,
    **reports.QUERIES,
    **models.QUERIES,
    **basics.QUERIES,
}
