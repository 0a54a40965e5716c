"""The registered queries, their checking SQL, and the views of the test tables they run on."""
