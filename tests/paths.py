"""Where the tests read tables."""

SF = "/root/testdata/sf0.001"
