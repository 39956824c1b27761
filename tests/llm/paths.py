SF = "/root/testdata/sf0.001"
SF_CHECKED = "/root/testdata/sf0.01"
