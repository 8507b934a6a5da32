"""Query, report, symbolisation, catalog and normalisation operators."""
