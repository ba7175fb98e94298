"""siteledger: Spark jobs for inventorying, projecting and reconciling web sites."""
